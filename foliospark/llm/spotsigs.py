"""SpotSigs document fingerprints.

At every anchor, a common word of the language, stands a spot signature: the anchor and the chain of the
next content words behind it, common words passed over. The text's start is an anchor too, so that every
text with a content word has a signature; a text of common words only has one of them all. A fingerprint
is the set of a text's signatures as 32-bit numbers, written in hex in rising order.

Likeness is the Jaccard similarity of two sets. Pairs are found by partitions of set length: a set is
compared only with sets whose length lets the similarity reach the threshold, and only with those that
share one of its rarest signatures; comparing stops as soon as the rest can't reach it.

Defined results: null is the empty text, whose set is empty; two empty sets are alike by 1, an empty and
another by 0; repeated rows are each other's neighbours in order of id and text, null ids come last; a
single row is its own neighbour; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Memo, cut, pieces

#: Common words of English, French, German and Spanish.
COMMON = (
    "the of and to in a is was that it for on are as with at by from this be have or not but "
    "le la les de des du un une et est que qui dans pour pas sur au avec par ne se ce il elle en "
    "der die das und den von zu mit ist dem im nicht ein eine auf für sich des als auch es werden aus "
    "el los las del y una por con para su al lo como más no o esta sus"
)
CHAIN = 2
#: From this similarity on two texts are told to be alike.
ALIKE = 0.8
#: Signatures that are compared at once.
BLOCK = 256
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…¡¿—–"
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Spotter:
    def __init__(self, common: str = COMMON, chain: int = CHAIN):
        self.common, self.chain = frozenset(common.split()), chain
        self.words = Memo(self._number)

    def _number(self, word: str) -> int:
        """A hash of the word; its last bit tells whether the word is common."""
        core = word.strip(_EDGE) or word
        return xxhash.xxh64_intdigest(core.encode("utf-8", "replace")) & ~1 | (core in self.common)

    def signatures(self, text: str | None) -> np.ndarray:
        """The sorted set of a text's signatures."""
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint32)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        common = (h & np.uint64(1)).astype(bool)
        content = h[~common]
        if not content.size:
            return np.array([xxhash.xxh32_intdigest(h.tobytes())], np.uint32)
        # The start of the text counts as an anchor; behind each stand the content words from `at` on.
        at = np.concatenate([[0], np.cumsum(~common)[common]])
        spots = np.concatenate([_M[:1], h[common]])[at < content.size]
        at = at[at < content.size]
        mixed = spots * _M[0]
        padded = np.concatenate([content, np.zeros(self.chain, np.uint64)])
        for k in range(self.chain):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _M[1] + padded[at + k] * _M[2]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _M[3]
        return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def written(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def read(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u4").astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets, 0 where it is under `least`: sets of length partitions that are no neighbours aren't compared, and
    comparing stops, after each block of signatures, as soon as those that are left can't reach it."""
    if not a.size or not b.size:
        return float(a.size == b.size)
    small, large = (a, b) if a.size <= b.size else (b, a)
    if least and (partition(large.size, least) - partition(small.size, least) > 1 or small.size < least * large.size):
        return 0.0
    shared, both = 0, small.size + large.size
    for k in range(0, small.size, BLOCK):
        block = small[k : k + BLOCK]
        place = np.searchsorted(large, block)
        place[place == large.size] = 0
        shared += int((large[place] == block).sum())
        most = shared + max(0, small.size - k - BLOCK)
        if most < least * (both - most):
            return 0.0
    return shared / (both - shared)


def partition(n: int, least: float) -> int:
    """The length partition of a set: sets whose similarity is `least` or more are in one or in neighbours."""
    return math.floor(math.log(n) / -math.log(least) + 1e-9)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", common: str = COMMON, chain: int = CHAIN) -> DataFrame:
    """Rows (id, signatures array<int>, n) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spotter = Spotter(common, chain)
        for batch in pieces(batches):
            sets = [spotter.signatures(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int32) for s in sets], pa.list_(pa.int32())), pa.array([s.size for s in sets], pa.int32())], ["id", "signatures", "n"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, signatures array<int>, n int")


def similar_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members (id, class, key), pairs (a, b, similarity, key_a, key_b) of classes): classes are texts of equal sets, named by their smallest id; pairs of classes reach the threshold.

    A key, the hash of a class's set, tells classes apart whose smallest ids are null or the same; a is the smaller id, null last.

    Each class is dealt out under its rarest signatures, so many that a pair at the threshold shares one,
    and under the length partitions that a partner can have. Classes without signatures have no partners.
    """
    sets = cut(fingerprints(docs, id_col, text_col))
    named = sets.withColumn("key", F.sha2(F.concat_ws(",", F.col("signatures").cast("array<string>")), 256))
    firsts = cut(named.groupBy("key").agg(F.min("id").alias("class"), F.first("signatures").alias("signatures"), F.first("n").alias("n")))
    members = named.select("id", "key").join(firsts.select("key", "class"), "key")
    classes = firsts.where("n > 0")
    spots = classes.select("key", F.explode("signatures").alias("s"), "n")
    often = cut(spots.groupBy("s").agg(F.count("*").alias("often")))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("often", "s"))
    rare = spots.join(often, "s").where("often > 1 OR n = 1").withColumn("rank", rank)
    # Of n signatures, n - ceil(threshold * n) + 1 suffice; those that no other class has only fill places.
    alone = spots.join(often, "s").groupBy("key").agg(F.count_if(F.col("often") == 1).alias("alone"))
    rare = rare.join(alone, "key").where(F.col("rank") + F.col("alone") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    step = float(np.log(1 / threshold))
    part = F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int")
    dealt = rare.select("key", "n", "s", part.alias("part"))
    left = dealt.select(F.col("key").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = dealt.select(F.col("key").alias("b"), F.col("n").alias("nb"), "s", "part")
    met = left.join(right, ["s", "part"]).where((F.col("a") != F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9))
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sides = [classes.select(F.col("key").alias(x), F.struct(F.col("class").isNull().alias("last"), "class", "key").alias(f"c{x}"), F.col("signatures").alias(f"s{x}")) for x in ("a", "b")]
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = met.join(sides[0], "a").join(sides[1], "b").withColumn("similarity", shared / (F.size("sa") + F.size("sb") - shared)).where(F.col("similarity") >= threshold)
    ends = alike.select(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y"), "similarity")
    pairs = ends.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), "similarity", F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"))
    return members.select("id", "class", "key"), pairs


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_LAST = -(1 << 63)


def with_next(docs: DataFrame, id_col: str, text_col: str, handle, schema: str) -> DataFrame:
    """handle(rows) for each sorted part of docs. Rows are (id, text) by falling id; each part ends with the row that follows it, which counts only as such.

    Ids are divided at estimated quantiles; the first row of a part, found by an aggregate over ids, is
    copied to the part before. The driver holds a few numbers for each part.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    base = docs.select(key.alias("k"), F.col(text_col).alias("text"))
    cuts = sorted(set((base.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None) or []))

    def part_of(ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.array(cuts, np.int64), ids, "right")

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[int, int] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for p, i in zip(part_of(ids).tolist(), ids.tolist(), strict=True):
                if i > top.get(p, _LAST - 1):
                    top[p] = i
        yield pa.RecordBatch.from_pydict({"p": pa.array(list(top), pa.int32()), "top": pa.array(list(top.values()), pa.int64())})

    tops = {r.p: r.top for r in base.select("k").mapInArrow(largest, "p int, top long").groupBy("p").agg(F.max("top").alias("top")).collect()}
    parts = sorted(tops)
    #: first id of a part -> the part that it follows: the next higher one, or for the highest part of all the lowest.
    follows = {tops[p]: parts[(k + 1) % len(parts)] for k, p in enumerate(parts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["p", "extra", "k", "text"]
        for batch in batches:
            ids = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(part_of(ids).astype(np.int32)), pa.array(np.zeros(ids.size, np.int8)), *batch.columns], names)
            first = np.flatnonzero(np.isin(ids, list(follows)))
            if first.size:
                copy = batch.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([pa.array([follows[i] for i in ids[first].tolist()], pa.int32()), pa.array(np.ones(first.size, np.int8)), *copy.columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in pieces(batches):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        yield from handle(rows())

    dealt = base.mapInArrow(deal, "p int, extra byte, k long, text string")
    dealt = dealt.repartitionById(max(1, len(cuts) + 1), F.col("p")) if hasattr(dealt, "repartitionById") else dealt.repartition(n, "p")
    return dealt.sortWithinPartitions("p", "extra", F.col("k").desc(), F.col("text").asc_nulls_first()).mapInArrow(run, schema)


EDITED = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, alike_edited boolean, alike_next boolean"


def against_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (EDITED): fingerprints of every text and of its edited text, their likeness to it and to the next text, and whether those reach ALIKE by the pruned comparison."""

    def handle(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        spotter, out, held = Spotter(), [], 0
        last = None  # (part, id, text, signatures)
        closed = False
        names = [x.split()[0] for x in EDITED.split(", ")]

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        for part, extra, key, text, *_ in rows:
            text = text or ""
            if last is None or last[0] != part:
                closed = False
            elif closed:
                continue
            own = spotter.signatures(text)
            if last is not None and last[0] == part:
                _, i, before, signatures = last
                changed = edited(before, text)
                other = spotter.signatures(changed)
                marks = (written(signatures), written(other))
                out.append((None if i == _LAST else i, len(before), hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(), *marks, likeness(signatures, other), likeness(signatures, own), likeness(signatures, other, ALIKE) > 0, likeness(signatures, own, ALIKE) > 0))
                held += len(marks[0]) + len(marks[1]) + 200
                if held > 4_000_000:
                    yield batch()
                    out, held = [], 0
            closed = bool(extra)
            last = (part, key, text, own)
        if out:
            yield batch()

    return with_next(docs, id_col, text_col, handle, EDITED)
