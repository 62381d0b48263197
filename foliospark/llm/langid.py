"""Language identification by cross-parsing.

For each language a suffix automaton is built over labelled text. A text is parsed against it greedily:
the longest match is taken, a phrase ends where the automaton has no way on, and the next starts there.
Phrases are normalised to bits for a character, phrases * log2(reference length + letters told apart) /
characters; the language that needs fewest wins. Texts are parsed whole. For speed, pieces of 256 letters
first advance together, each as if a phrase began there; then each goes on into the next piece until the two
parses are in one state, from where on they agree. So the phrases are those of one parse from start to end.

Automata are kept as displaced rows: a state's letters stand at its base, in places that other states leave free.

Fitting reads `per_language` whole labelled texts of each language, those of the smallest hash of their id among
texts of up to `longest` characters, then the next longer ones; all three bounds of training_rows() are parameters. A
language's reference is all of that, however little text another language has. A language all of whose texts are
longer than `most` is not learned. Prediction uses only the text.

Defined results: a text that is null or has no letter is `und` with score 0; ties go to the language first
in code-point order; repeated rows each keep a row; a null id is held out; without any labelled text all
is `und`; extra columns are ignored, or carried in a struct whatever they are called.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, in_small_batches, pieces

PIECE = 256
SPACE, OTHER = 0, 1
#: Characters of which the longer pieces differ in sureness no more.
SURE = 120


@dataclass
class Table:
    """An automaton's transitions: `to` of a state and letter stands at base[state] + letter if `owner` there is the state."""

    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    restart: np.ndarray  # [letter]: the state of a phrase that begins with it

    def step(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase ended before the letter)."""
        at = self.base.take(state)
        at += letter
        ended = self.owner.take(at) != state
        return np.where(ended, self.restart.take(letter), self.to.take(at)), ended


@dataclass
class Model:
    langs: list[str]
    letters: str
    tables: list[Table]
    bits: list[float]  # of a phrase

    @property
    def width(self) -> int:
        return len(self.letters) + 2


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of seq; state 0 is the start."""
    nxt, link, size, last = [{}], [-1], [0], 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def _displaced(nxt: list[dict[int, int]], width: int) -> Table:
    """States of several letters are put where all their places are free; those of one letter fill what is left."""
    many = sorted((s for s, row in enumerate(nxt) if len(row) > 1), key=lambda s: -len(nxt[s]))
    used, base, low, top = bytearray(4 * width), np.full(len(nxt), width, np.int32), width, width
    for s in many:
        one, *more = nxt[s]
        place, tries = low, 0
        while True:
            place = used.find(0, place)
            if place < 0 or place + 2 * width > len(used):
                used.extend(bytes(len(used)))
                place = max(place, low)
            elif place - one >= width and not any([used[place - one + c] for c in more]):
                break
            else:
                place, tries = place + 1, tries + 1
        low = place if tries > 8 else low
        at, letters = place - one, nxt[s]
        for c in letters:
            used[at + c] = 1
        base[s], top = at, max(top, at)
    single = [s for s, row in enumerate(nxt) if len(row) == 1]
    free = np.flatnonzero(np.frombuffer(bytes(used), np.uint8)[width:] == 0) + width
    free = np.concatenate([free, len(used) + np.arange(max(0, len(single) - free.size))])[: len(single)]
    size = int(max([top, len(used), *(free[-1:] + 1)])) + 2 * width
    owner, to = np.full(size, -1, np.int32), np.zeros(size, np.int32)
    for s, place in zip(single, free.tolist(), strict=True):
        base[s] = place - next(iter(nxt[s]))
    for s, row in enumerate(nxt):
        for c, t in row.items():
            owner[base[s] + c], to[base[s] + c] = s, t
    restart = np.array([nxt[0].get(c, 0) for c in range(width)], np.int32)
    return Table(base, owner, to, restart)


def _plain(text: str) -> str:
    """Lower case, with one space for whatever stands between letters."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def fit(rows: list[tuple[str, str]], letters: int = 120) -> Model:
    """A model of (language, text) rows. letters: the most frequent are told apart, the rest are one."""
    texts: dict[str, list[str]] = {}
    for lang, text in sorted(rows):
        if p := _plain(text):
            texts.setdefault(lang, []).append(p)
    langs = sorted(texts)
    counts = Counter(c for k in langs for t in texts[k] for c in t if c != " ")
    alphabet = "".join(c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:letters])
    index = {c: k + 2 for k, c in enumerate(alphabet)} | {" ": SPACE}
    width = len(alphabet) + 2
    tables, bits = [], []
    for k in langs:
        seq = [index.get(c, OTHER) for c in " ".join(texts[k])]
        tables.append(_displaced(suffix_automaton([SPACE, *seq]), width))
        # A phrase is a place in the reference or a letter by itself: a tiny reference doesn't make phrases cheap.
        bits.append(math.log2(len(seq) + width))
    return Model(langs, alphabet, tables, bits)


class Parser:
    def __init__(self, model: Model):
        self.model = model
        self.classes = np.full(0x110000, SPACE, np.uint8)
        letter = np.array([chr(c).isalpha() for c in range(0x110000)])
        self.classes[letter] = OTHER
        for k, c in enumerate(model.letters):
            self.classes[ord(c)] = k + 2
            for other in (c.upper(), c.title()):
                if len(other) == 1:
                    self.classes[ord(other)] = k + 2

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """([text, language] phrases, letters and spaces of each text)."""
        sizes = np.array([len(t or "") for t in texts], np.int64)
        cls = self.classes[np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "replace"), np.uint32)]
        doc = np.repeat(np.arange(len(texts)), sizes)
        # One space between words, none at a text's ends.
        here = cls != SPACE
        first = np.concatenate([[True], doc[1:] != doc[:-1]]) if doc.size else np.zeros(0, bool)
        before = np.concatenate([[False], here[:-1]]) if doc.size else np.zeros(0, bool)
        keep = here | (before & ~first)
        cls, doc = cls[keep], doc[keep]
        inner = (cls != SPACE) | (np.append(doc[1:], -1) == doc)
        cls, doc = cls[inner], doc[inner]
        n = np.bincount(doc, minlength=len(texts))
        starts = np.cumsum(n) - n
        parts = -(-n // PIECE)
        owner = np.repeat(np.arange(len(texts)), parts)
        number = np.arange(owner.size) - np.repeat(np.cumsum(parts) - parts, parts)
        size = np.minimum(PIECE, n[owner] - number * PIECE)
        # Long pieces first; before: the piece before each, or -1.
        order = np.argsort(-size, kind="stable")
        place = np.empty(order.size, np.int64)
        place[order] = np.arange(order.size)
        before, after = (np.full(order.size, -1) for _ in range(2))
        later = np.flatnonzero(number > 0)
        before[place[later]], after[place[later - 1]] = place[later - 1], place[later]
        owner, size, begin = owner[order], size[order], (starts[owner] + number * PIECE)[order]
        columns = [cls[begin[:m] + k].astype(np.int32) for k, m in enumerate(np.searchsorted(-size, -np.arange(PIECE), "left").tolist()) if m]
        out = np.zeros((len(texts), len(self.model.langs)))
        for k, table in enumerate(self.model.tables):
            out[:, k] = np.bincount(owner, self._parse(table, columns, size, before, after), len(texts)) + 1
        return out, n

    @staticmethod
    def _parse(table: Table, columns: list[np.ndarray], size: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """How many phrases end within each piece of texts that are parsed from start to end. columns: the k-th letters of all pieces that have so many."""
        states, state = [], np.zeros(size.size, np.int32)
        ended, counts = [], np.zeros(size.size, np.int64)
        for letters in columns:
            state, over = table.step(state[: letters.size], letters)
            states.append(state)
            ended.append(over)
            counts[: letters.size] += over
        # Each piece goes on where the one before it has ended, until it is in the state that was guessed.
        lanes = np.flatnonzero(before >= 0)
        while lanes.size:
            last = size[before[lanes]] - 1
            state = np.empty(lanes.size, np.int32)
            for k in np.unique(last).tolist():
                state[last == k] = states[k][before[lanes[last == k]]]
            going, missed = lanes, []
            for k, letters in enumerate(columns):
                state, over = table.step(state, letters[going])
                counts[going] += over.astype(np.int64) - ended[k][going]
                ended[k][going] = over
                differs = states[k][going] != state
                states[k][going] = state
                done = size[going] == k + 1
                missed.append(going[differs & done])
                going, state = going[differs & ~done], state[differs & ~done]
                if not going.size:
                    break
            # A piece that never met its guess hands on another state than before.
            lanes = after[np.concatenate(missed)]
            lanes = lanes[lanes >= 0]
        return counts

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        counts, n = self.phrases(texts)
        if not self.model.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        rate = counts * np.array(self.model.bits) / np.maximum(n, 1)[:, None]
        best = rate.argmin(1)
        surplus = (rate - rate.min(1, keepdims=True)) * np.minimum(n, SURE)[:, None] * math.log(2)
        score = 1 / np.exp(-np.minimum(surplus, 700)).sum(1)
        return [self.model.langs[b] if m else "und" for b, m in zip(best, n, strict=True)], np.where(n > 0, score, 0.0)


def fold(id_col: Column, of: int) -> Column:
    """The CRC-32 of the id as text, modulo `of`; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % of


def training_rows(docs: DataFrame, usable: Column, per_language: int = 50, longest: int = 2000, most: int = 100_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """The bounded sample: (language, whole text) of up to `per_language` usable texts of each language, of `most` characters together."""
    size = F.length("text")
    rank = Window.partitionBy("lang").orderBy("longer", "place", "text")
    rows = docs.where(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("place"))
    rows = rows.where(size <= most).withColumn("longer", F.when(size > longest, size).otherwise(0))
    rows = rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= per_language)
    rows = rows.withColumn("upto", F.sum(size).over(rank.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("upto") <= most) | (F.col("rank") == 1))
    return [(r.lang, r.text) for r in rows.select("lang", "text").collect()]


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Rows (carried, lang_pred, score), one for each row of docs; carried: the columns of `keep` in a struct."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the reference texts, not by the corpus
    in_small_batches(docs.sparkSession)
    kept = docs.select(carried(keep), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = None
        for batch in pieces(batches, 3_000_000):
            parser = parser or Parser(held.value)
            langs, score = parser.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], ["carried", "lang_pred", "score"])

    return kept.mapInArrow(run, kept.drop("text").schema.add("lang_pred", "string").add("score", "double"))
