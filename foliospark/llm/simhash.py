"""SimHash fingerprints and the near-duplicate classes they form.

Two 64-bit fingerprints within three bits differ in at most three of their eight bytes, so they
share five positional bytes or more. The inverted index is keyed by four byte positions at once: of
the fourteen 4-sets of positions 0..7 whose exclusive-or is zero, every 5-set of positions holds
exactly one, so no link is missed and a list holds only fingerprints that agree in 32 bits. Within
a list the shared positional bytes of a pair are tallied, pairs reaching five are kept and then
verified bit by bit. A list yields a spanning forest of its links and not all its pairs.

For near copies that differ in more bits (wide_links()), two fingerprints of a text are held: one of two-word shingles, found through lists
of two positional bytes each, so that pairs share two bytes at least and up to six differing bits can't be missed; and one of
five-word shingles, which verifies. A pair links within ten bits of the first and fourteen of the second.

Defined results: null, empty or blank text has fingerprint zero, and all such texts link. Repeated
rows each keep a row. A null id has a row; it is never a class's smallest id unless all ids there
are null (then the class id is null). Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, cut, in_small_batches, pieces

SEED, SHINGLE, BITS = 42, 3, 3
#: The fourteen position sets.
BLOCKS = [b for b in combinations(range(8), 4) if b[0] ^ b[1] ^ b[2] ^ b[3] == 0]
#: Of wide links: words of a shingle and most differing bits, of the fingerprint that finds and of the one that verifies; the pairs of byte positions.
FIND, VERIFY = (2, 10), (5, 14)
PAIRS = list(combinations(range(8), 2))
#: Lists longer than this are divided by a fifth byte.
LONG_LIST = 4096
_BIT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_AT = np.arange(8, dtype=np.int32) * 256


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text: a bit is 1 if more than half of the shingles' hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else [b" ".join(words)]
    n = max(1, len(words) - width + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    octets = hashes.view(np.uint8).reshape(n, 8)
    if n < 200:
        ones = np.unpackbits(octets, axis=1, bitorder="little").sum(0)
    else:
        ones = np.einsum("pb,bk->pk", np.bincount((octets + _AT).ravel(), minlength=2048).reshape(8, 256), _BIT).ravel()
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, hashed: bool = False, check: int | None = None) -> DataFrame:
    """Rows (id, fp): fp is the fingerprint as a signed long. hashed: also text_hash, the text's xxhash64. check: also the fingerprint of shingles of so many words."""
    extra = [F.xxhash64(text_col).alias("text_hash")] if hashed else []
    names = ["id", "fp", *["text_hash"] * hashed, *["check"] * (check is not None)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = byte_texts(batch.column(1))
            fps = [pa.array(np.array([fingerprint(t, w) for t in texts], np.uint64).view(np.int64)) for w in (width, *([check] if check else []))]
            yield pa.RecordBatch.from_arrays([batch.column(0), fps[0], *batch.columns[2:], *fps[1:]], names)

    in_small_batches(docs.sparkSession)
    told = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *extra)
    return told.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def forest(fps: np.ndarray, bits: int = BITS) -> Iterator[tuple[int, np.ndarray]]:
    """(a, array of b): links of one list that connect what any of its links connect. fps: distinct."""
    left = fps
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            x = left ^ queue[-1]
            tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
            near = (tally >= 8 - bits) & (np.bitwise_count(x) <= bits)
            a = queue.pop()
            if near.any():
                yield a, left[near]
                queue.extend(left[near])
                left = left[~near]


def _list_links(block: int, fps: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    if fps.size <= LONG_LIST:
        yield from forest(fps, bits)
        return
    octets = fps.view(np.uint8).reshape(-1, 8)
    for p in set(range(8)) - set(BLOCKS[block]):
        order = np.argsort(octets[:, p], kind="stable")
        for part in np.split(fps[order], np.flatnonzero(np.diff(octets[order, p])) + 1):
            if part.size > 1:
                yield from forest(part, bits)


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all that lie within `bits` bits, of which there may be three: the position sets
    hold five shared bytes or more."""
    if not 0 <= bits <= BITS:
        raise ValueError(f"links are found within 0 to {BITS} bits, not {bits}")
    octet = lambda p: F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255))
    packed = lambda b: sum((F.shiftleft(octet(p), 8 * k) for k, p in enumerate(b[1:], 1)), octet(b[0]))
    keys = F.array(*[packed(b) + F.lit(k << 32) for k, b in enumerate(BLOCKS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # of the list that is still open
        key = None

        def close(a: list, b: list) -> None:
            if kept and sum(x.size for x in kept) > 1:
                for one, more in _list_links(int(key) >> 32, np.concatenate(kept), bits):
                    a.append(np.full(more.size, one, np.uint64))
                    b.append(more)

        def out(a: list, b: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64))], ["a", "b"])

        for batch in batches:
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            ks, fs = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.concatenate([[True], ks[1:] != ks[:-1]])) if ks.size else np.array([], np.int64)
            ends = np.append(starts[1:], ks.size)
            single = ends - starts == 1
            for s, e, alone in zip(starts.tolist(), ends.tolist(), single.tolist(), strict=True):
                if ks[s] != key:
                    close(a, b)
                    kept, key = [], ks[s]
                elif alone:
                    alone = False
                kept.append(fs[s:e])
            if a:
                yield out(a, b)
        a, b = [], []
        close(a, b)
        if a:
            yield out(a, b)

    dealt = distinct.select(F.explode(keys).alias("key"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def wide_forest(nodes: np.ndarray, fps: np.ndarray, checks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(a, array of b): links of one list that connect what any of its pairs, near in both fingerprints, connects."""
    left = np.arange(nodes.size)
    while left.size > 1:
        queue, left = [left[0]], left[1:]
        while queue and left.size:
            a = queue.pop()
            near = (np.bitwise_count(fps[left] ^ fps[a]) <= FIND[1]) & (np.bitwise_count(checks[left] ^ checks[a]) <= VERIFY[1])
            if near.any():
                yield nodes[a], nodes[left[near]]
                queue.extend(left[near])
                left = left[~near]


def wide_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between nodes (node, fp, check) that connect all pairs that share two positional bytes of fp and are near in both fingerprints."""
    octet = lambda p: F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = F.array(*[octet(p) + F.shiftleft(octet(q), 8) + F.lit(k << 16) for k, (p, q) in enumerate(PAIRS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # of the list that is still open: rows of key, node, fp, check

        def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            ends = np.flatnonzero(np.diff(rows[0])) + 1
            a, b = [], []
            for start, end in zip(np.concatenate([[0], ends]).tolist(), [*ends.tolist(), rows.shape[1]], strict=True):
                if end - start > 1:
                    for one, more in wide_forest(rows[1, start:end], *rows[2:, start:end].view(np.uint64)):
                        a.append(np.full(more.size, one))
                        b.append(more)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy() for c in batch.columns])
            last = int(np.searchsorted(rows[0], rows[0, -1]))  # keys are in order; the last list may go on
            if last:
                yield from linked(np.hstack([*kept, rows[:, :last]]))
                kept = []
            elif kept and kept[-1][0, -1] != rows[0, 0]:
                yield from linked(np.hstack(kept))
                kept = []
            kept.append(rows[:, last:])
        if kept:
            yield from linked(np.hstack(kept))

    dealt = distinct.select(F.explode(keys).alias("key"), "node", "fp", "check")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key").sortWithinPartitions("key", "fp", "check").mapInArrow(run, "a long, b long")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root: the component's smallest node.

    Alternating large and small stars, each round cut to a table; nothing is gathered on the driver but a count and a sum.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: of each node, the neighbours above it go to the least of its neighbourhood.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: of each node, the neighbours below it and itself go to the least.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = cut(small.distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
    raise RuntimeError("the components have not settled")


def rooted(distinct: DataFrame, edges: DataFrame, node: str = "fp") -> DataFrame:
    """distinct (a row for each node) with `root`, the smallest node of its class."""
    return distinct.join(components(edges).withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Rows (id, fp, component_id), one for each row of docs: the class's smallest id."""
    fps = cut(fingerprints(docs, id_col, text_col, width))
    distinct = cut(fps.groupBy("fp").agg(F.min("id").alias("least")))
    named = rooted(distinct, links(distinct.select("fp"), bits))
    classes = named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(classes, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """docs with one row of each class: that of the smallest id, null ids last, and among rows of that id that of the smallest text hash.

    Classes are those of three bits, or with `wide` those of wide_links(). Of rows alike in id and text one stays. Ids needn't tell rows apart: classes
    whose ids are all null, or that share their smallest id, each keep a row.
    """
    if wide:
        fps = fingerprints(docs, id_col, text_col, FIND[0], hashed=True, check=VERIFY[0]).withColumn("node", F.xxhash64("fp", "check"))
    else:
        fps = fingerprints(docs, id_col, text_col, hashed=True).select(F.col("fp").alias("node"), "*", F.lit(0).alias("check"))
    fps = fps.groupBy("node", "fp", "check", "id", "text_hash").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "text_hash", "rows")).alias("first")
    distinct = cut(fps.groupBy("node", "fp", "check").agg(first))
    edges = wide_links(distinct.select("node", "fp", "check")) if wide else links(distinct.select("fp"))
    least = rooted(distinct, edges, "node").groupBy("root").agg(F.min("first").alias("first"))
    firsts = cut(least.select(F.col("first.id").alias("_first"), F.col("first.text_hash").alias("_hash"), F.col("first.rows").alias("_rows")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("carried"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("hash"))
    same = rows["id"].eqNullSafe(F.col("_first")) & (rows["hash"] == F.col("_hash"))
    kept = rows.join(firsts, same, "left_semi")
    many = firsts.where("_rows > 1")
    if many.isEmpty():
        return kept.select("carried.*")
    return kept.join(many, same, "left_anti").unionByName(kept.join(many, same, "left_semi").dropDuplicates(["id", "hash"])).select("carried.*")
