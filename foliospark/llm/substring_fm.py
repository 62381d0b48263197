"""Removal of repeated word sequences, exactly, with compressed FM-indexes over shards.

A window is `length` consecutive words of a document. Every window has an anchor: of its runs of `gram`
words, the leftmost of least order. Windows that are equal have equal anchors at equal places, so they
meet if windows are dealt out by anchor. A segment is what consecutive windows with one anchor cover.
Runs of words that many documents of a sample have come last in that order, so that windows with any
words of their own are anchored there; the order changes which windows meet in a task, never the result.

1. Each task finds the segments of its documents. Of equal segments it sends on the first two.
2. By anchor: an anchor of one occurrence has no repeats. Of the others the first two occurrences of each
   different segment are candidates. An occurrence with two before it is a repeat as the second is one.
   An anchor with more than MANY different segments is dealt anew by single windows, so that no anchor is
   one task's work.
3. Candidates fetch their words. A shard of anchors indexes them: the Burrows-Wheeler transform in a
   wavelet matrix with rank blocks, and every eighth place of the suffix array. The candidates' texts are
   streamed against it: backward search, for all ends at once and a word at a time, gives each end's
   matching statistic, the longest word sequence up to it that occurs elsewhere. Ends of `length` or more
   are reported where an occurrence of the last `length` words, found by walking the transform, starts earlier.
4. Reported windows, as intervals, meet their documents.

Words are told apart by 64-bit hashes (segments by 128 bits) up to step 2, by their bytes in step 3.

Defined results: null text has no words; texts of fewer than `length` words lose none; rows with equal id
and text are one document, rows with equal ids and different texts are ordered by a hash of the text, null
ids come last; no documents give no rows; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, byte_texts, cut, in_small_batches, pieces, ranked

LENGTH, GRAM = 20, 7
#: Rows a task holds before it tells equal segments, different segments of an anchor that is dealt by windows instead, words of a shard.
HELD, MANY, SHARD_WORDS = 1_000_000, 1_000, 300_000
#: Windows a task holds before it sends on those of anchors that are dealt by windows.
HELD_WINDOWS = 200_000
#: Common runs of words are learned from so many documents of at most so many characters; a run is common if so many of them have it.
SAMPLED, SAMPLED_CHARS, COMMON_IN = 2_000, 20_000, 4
#: Every so many places of the suffix array are kept.
KEPT = 8
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_STEPS = [(0xBF58476D1CE4E5B9 * (2 * k + 1) ^ 0x94D049BB133111EB * k) & _MASK | 1 for k in range(64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse, modulo 2 ** 64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if self.up.size <= n:
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n + 1, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


class Segmenter:
    def __init__(self, length: int = LENGTH, gram: int = GRAM, common: np.ndarray | None = None):
        self.length, self.gram, self.span = length, gram, length - gram + 1
        self.hashes = Memo(xxhash.xxh64_intdigest)
        self.powers = _Powers()
        self.common = common if common is not None and common.size else None
        if self.common is not None:
            self.maybe = np.zeros(1 << 22, bool)
            self.maybe[(self.common & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def words(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the words of texts with a window, words of each text; 0 without a window)."""
        flat: list[bytes] = []
        sizes = np.zeros(len(texts), np.int64)
        for k, t in enumerate(texts):
            words = t.split() if t else []
            if len(words) >= self.length:
                sizes[k] = len(words)
                flat += words
        return np.fromiter(map(self.hashes.__getitem__, flat), np.uint64, len(flat)), sizes

    def grams(self, h: np.ndarray) -> np.ndarray:
        """Hashes of the runs of words that start at each place, of 63 bits."""
        grams = np.zeros(h.size, np.uint64)
        for k in range(min(self.gram, h.size)):
            grams[: h.size - k] += h[k:] * np.uint64(_STEPS[k])
        return _mixed(grams) >> np.uint64(1)

    def _ordered(self, grams: np.ndarray) -> np.ndarray:
        """grams, common ones behind all others."""
        if self.common is None:
            return grams
        at = np.flatnonzero(self.maybe[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        place = np.searchsorted(self.common, grams[at])
        place[place == self.common.size] = 0
        at = at[self.common[place] == grams[at]]
        grams[at] |= np.uint64(1 << 63)
        return grams

    def segments(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """(anchor, content hash, text, first word, windows, words before the anchor) of every segment."""
        h, sizes = self.words(texts)
        n = h.size
        if not n:
            return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 4
        grams = self._ordered(self.grams(h))
        # Leftmost least gram of each window, by doubling.
        value, place, wide = grams, np.arange(n), 1
        while wide < self.span:
            step = min(wide, self.span - wide)
            right = value[step:] < value[: n - step]
            value = np.concatenate([np.where(right, value[step:], value[: n - step]), value[n - step :]])
            place = np.concatenate([np.where(right, place[step:], place[: n - step]), place[n - step :]])
            wide += step
        text = np.repeat(np.arange(sizes.size), sizes)
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        at = np.arange(n)
        valid = at + self.length <= start + sizes[text]
        runs = valid & np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
        first = np.flatnonzero(runs)
        # A run ends where the next starts or where its text has no more windows.
        ends = np.minimum(np.append(first[1:], n), (start + sizes[text] - self.length + 1)[first])
        up, down = self.powers.upto(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
        windows, lead = ends - first, place[first] - first
        content = (sums[ends + self.length - 1] - sums[first]) * down[first]
        content = _mixed(content + windows.astype(np.uint64) * np.uint64(_STEPS[60]) + lead.astype(np.uint64) * np.uint64(_STEPS[61]))
        return grams[place[first]], content, text[first], first - start[first], windows, lead


def common_grams(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc", text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the runs of `gram` words that COMMON_IN documents or more of a sample have.

    The sample is SAMPLED documents of the smallest hash, of SAMPLED_CHARS characters at most: 40 MB at most, and a fraction of that in hashes.
    What it holds only changes how evenly anchors are dealt.
    """
    text = F.col(text_col)
    # About one row in `step`, so that tasks send few on, however many there are.
    step, place = max(1, docs.count() // SAMPLED), F.xxhash64(F.lit(7), id_col, text_col)
    short = docs.where(text.isNotNull() & (F.length(text) <= SAMPLED_CHARS) & (F.pmod(place, F.lit(step)) == 0))
    some = short.select(text.alias("text"), place.alias("place")).orderBy("place").limit(SAMPLED).select("text").toArrow()
    segmenter, found = Segmenter(length, gram), []
    for t in byte_texts(some.column(0).combine_chunks()) if some.num_rows else []:
        h, _ = segmenter.words([t])
        found.append(np.unique(segmenter.grams(h)[: max(0, h.size - gram + 1)]))
    grams, times = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, int))
    return grams[times >= COMMON_IN]


def _pack(pos: np.ndarray, windows: np.ndarray, lead: np.ndarray) -> np.ndarray:
    return (pos << 16) | (windows << 8) | lead


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _occurrences(anchor: np.ndarray, content: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(sorted rows without repetitions, which occurrence of its segment each is, from 0)."""
    order = np.lexsort((at, doc, content, anchor))
    rows = [x[order] for x in (anchor, content, doc, at)]
    differs = lambda xs: np.concatenate([[True], np.any([x[1:] != x[:-1] for x in xs], axis=0)]) if xs[0].size else np.zeros(0, bool)
    own = differs(rows)
    rows = [x[own] for x in rows]
    new = differs(rows[:2])
    return rows, np.arange(new.size) - np.maximum.accumulate(np.where(new, np.arange(new.size), 0))


_DEALT = ["anchor", "content", "doc", "at"]


def _find(length: int, gram: int, common):
    """Step 1. A negative `at` marks a repeat that is already told; its anchor only spreads it."""

    def tell(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        (anchor, content, doc, at), nth = _occurrences(*(np.concatenate(x) for x in zip(*found, strict=True)))
        told = nth > 1
        anchor = np.where(told, _mixed(doc.view(np.uint64)), anchor)
        return _batch(_DEALT, anchor.view(np.int64), content.view(np.int64), doc, np.where(told, -at - 1, at))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter, found, held = Segmenter(length, gram, common.value), [], 0
        for batch in pieces(batches, 2_000_000):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            anchor, content, text, pos, windows, lead = segmenter.segments(byte_texts(batch.column(1)))
            found.append((anchor, content, ids[text].astype(np.int64), _pack(pos, windows, lead)))
            held += anchor.size
            if held > HELD:
                yield tell(found)
                found, held = [], 0
        if held:
            yield tell(found)

    return run


_TOLD = ["kind", "anchor", "doc", "at"]
REPEAT, CANDIDATE, CANDIDATE_OF_MANY = 0, 1, 2


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, over rows sorted by anchor. Of an anchor with more rows than a task holds, every part has its own first occurrences: candidates, so nothing is lost."""
    held: list[np.ndarray] = [np.zeros(0, np.int64) for _ in range(4)]
    divided = None  # the anchor whose rows go on from the part before

    def out(rows: list[np.ndarray], cut_off: bool) -> pa.RecordBatch:
        nonlocal divided
        (anchor, _, doc, at), nth = _occurrences(*rows)
        group = np.cumsum(np.concatenate([[True], anchor[1:] != anchor[:-1]])) - 1
        segments, occurrences = np.bincount(group, nth == 0), np.bincount(group)
        if anchor[0] == divided:
            segments[0] = occurrences[0] = MANY + 1
        if cut_off:
            segments[-1] = occurrences[-1] = MANY + 1
        divided = anchor[-1] if cut_off else None
        kind = np.where(nth > 1, REPEAT, np.where(segments[group] > MANY, CANDIDATE_OF_MANY, CANDIDATE)).astype(np.int8)
        keep = occurrences[group] > 1
        return _batch(_TOLD, kind[keep], anchor[keep], doc[keep], at[keep])

    for batch in batches:
        rows = [c.to_numpy() for c in batch.columns]
        told = rows[3] < 0
        if told.any():
            yield _batch(_TOLD, np.zeros(told.sum(), np.int8), rows[0][told], rows[2][told], -rows[3][told] - 1)
            rows = [r[~told] for r in rows]
        held = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if held[0].size > HELD // 8:
            last = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last anchor may go on
            cut_off = held[0].size - last > HELD
            last = held[0].size if cut_off else last
            if last:
                yield out([h[:last] for h in held], cut_off)
                held = [h[last:] for h in held]
    if held[0].size:
        yield out(held, False)


_FETCHED = ["anchor", "doc", "at", "words"]


def _fetch(length: int):
    """Step 3: the words of candidates, as (anchor, doc, at, words). A negative `at` marks a repeat that is already told."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[tuple[int, int]]] = {}  # the first two places of each window, of anchors dealt by windows

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _FETCHED)

        def release() -> list[tuple]:
            out = [(xxhash.xxh64_intdigest(w) - (1 << 63), doc, at, w) for w, places in held.items() for doc, at in places]
            held.clear()
            return out

        for batch in pieces(batches, 2_000_000):
            rows: list[tuple] = []
            wanted = [batch.column(k).to_pylist() for k in (2, 3, 4)]
            for doc, text, a, p, k in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1)), *wanted, strict=True):
                words = (text or b"").split()
                for anchor, at, kind in set(zip(a, p, k, strict=True)):
                    pos, windows = at >> 16, at >> 8 & 255
                    if kind == CANDIDATE:
                        rows.append((anchor, doc, at, b" ".join(words[pos : pos + windows + length - 1])))
                        continue
                    for s in range(pos, pos + windows):
                        places = held.setdefault(b" ".join(words[s : s + length]), [])
                        if (doc, s << 16 | 1 << 8) not in places:
                            places.append((doc, s << 16 | 1 << 8))
                            if len(places) > 2:
                                places.sort()
                                later, there = places.pop()
                                rows.append((hash((later, there)), later, -there - 1, None))
            if len(held) > HELD_WINDOWS:
                rows += release()
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of(release())

    return run


class Bits:
    """A bit vector with counts of the ones before each block of 64."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.concatenate([bits, np.zeros(64 + -bits.size % 64, bool)]), bitorder="little").view(np.uint64)
        self.counts = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words))])[:-1].astype(np.uint32)

    def ones(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = place >> 6
        return self.counts[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.words[place >> 6] >> (place & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class FmIndex:
    """Compressed full-text index of a sequence of numbers 0..sigma-1 whose suffixes all differ within `depth` numbers."""

    def __init__(self, text: np.ndarray, sigma: int, depth: int):
        n = text.size
        order = self._suffixes(text.astype(np.int64), sigma, depth)
        last = text[order - 1]  # the Burrows-Wheeler transform, circular
        kept = order % KEPT == 0
        self.kept, self.places = Bits(kept), order[kept].astype(np.uint32)
        self.size, self.before = n, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma]
        self.levels = max(1, int(sigma - 1).bit_length())
        self.zeros: list[int] = []
        self.bits: list[Bits] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (last >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(n - int(bit.sum()))
            last = np.concatenate([last[~bit], last[bit]])
        self.origin = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    @staticmethod
    def _suffixes(text: np.ndarray, sigma: int, depth: int) -> np.ndarray:
        """The suffix array: ranks by the first numbers of each suffix, which double until they tell all suffixes apart."""
        n, wide = text.size, int(sigma).bit_length()
        rank, k = np.zeros(n, np.int64), min(n, max(1, 62 // wide))
        for j in range(k):
            rank <<= wide
            rank[: n - j] |= text[j:] + 1
        order = np.argsort(rank)
        while True:
            sorted_ = rank[order]
            fresh = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
            if fresh[-1] == n - 1 or k > depth:
                return order
            rank = np.empty(n, np.int64)
            rank[order] = fresh + 1
            key = rank << 32
            key[: max(0, n - k)] |= rank[k:]
            rank, k = key, 2 * k
            order = np.argsort(rank)

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Through the levels of the wavelet matrix: where `place` leads for `symbol`."""
        for bits, zeros, level in zip(self.bits, self.zeros, range(self.levels - 1, -1, -1), strict=True):
            ones = bits.ones(place)
            place = np.where(symbol >> level & 1, zeros + ones, place - ones)
        return place

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of `symbol` followed by what the intervals stand for."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        shift = self.before[symbol] - self.origin[symbol]
        return both[: symbol.size] + shift, both[symbol.size :] + shift

    def step(self, row: np.ndarray) -> np.ndarray:
        """The rows of the suffixes that start one place before."""
        symbol, place = np.zeros(row.size, np.int64), row
        for bits, zeros in zip(self.bits, self.zeros, strict=True):
            bit, ones = bits.at(place), bits.ones(place)
            symbol, place = symbol << 1 | bit, np.where(bit, zeros + ones, place - ones)
        return self.before[symbol] + place - self.origin[symbol]

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The places in the text of rows: walked back to the next place that is kept."""
        out = np.zeros(row.size, np.int64)
        open_, steps = np.arange(row.size), 0
        while open_.size:
            here = self.kept.at(row)
            out[open_[here]] = self.places[self.kept.ones(row[here])] + steps
            open_, row, steps = open_[~here], self.step(row[~here]), steps + 1
        return out

    def matches(self, text: np.ndarray, ends: np.ndarray, room: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matching statistic of each end, low, high): the longest sequence of text up to the end, `room` numbers at most, that the index
        has twice or more; and, where that is `least` or more, the interval of the last `least` of them."""
        longest = np.zeros(ends.size, np.int64)
        at_least = (np.zeros(ends.size, np.int64), np.zeros(ends.size, np.int64))
        which = np.arange(ends.size)
        low, high = np.zeros(ends.size, np.int64), np.full(ends.size, self.size, np.int64)
        k = 0
        while which.size:
            low, high = self.extend(text[ends[which] - k], low, high)
            k += 1
            more = high - low > 1
            which, low, high = which[more], low[more], high[more]
            longest[which] = k
            if k == least:
                at_least[0][which], at_least[1][which] = low, high
            more = room[which] > k
            which, low, high = which[more], low[more], high[more]
        return longest, *at_least


def later_windows(segments: list[bytes], key: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, window, matching statistic of its end) of the windows that occur earlier. key: order of the segments' first windows, with room for `windows` after each."""
    n, codes = len(segments), defaultdict(count().__next__)
    # Each segment ends in a number of its own, so that all suffixes differ.
    size = windows + length
    first = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.int64)
    inside = np.ones(flat.size, bool)
    inside[first + size - 1] = False
    flat[inside] = np.fromiter(map(codes.__getitem__, b" ".join(segments).split()), np.int64, int(inside.sum())) + n
    flat[~inside] = np.arange(n)
    index = FmIndex(flat, len(codes) + n, int(size.max()))
    segment = np.repeat(np.arange(n), windows)
    offset = np.arange(segment.size) - np.repeat(np.cumsum(windows) - windows, windows)
    start = first[segment] + offset
    # Equal segments have equal answers: one of them is searched for.
    firsts: dict[bytes, int] = {}
    same = np.fromiter((firsts.setdefault(s, k) for k, s in enumerate(segments)), np.int64, n)
    asked = np.flatnonzero(same[segment] == segment)
    longest, low, high = (np.zeros(segment.size, np.int64) for _ in range(3))
    longest[asked], low[asked], high[asked] = index.matches(flat, start[asked] + length - 1, offset[asked] + length, length)
    of = (np.cumsum(windows) - windows)[same[segment]] + offset
    longest, low, high = longest[of], low[of], high[of]
    which = np.flatnonzero(longest >= length)
    if not which.size:
        return segment[:0], offset[:0], longest[:0]
    rank = np.full(flat.size, np.iinfo(np.int64).max)
    rank[start] = key[segment] + offset
    edges, place = np.unique(low[which], return_inverse=True)
    tops = np.zeros(edges.size, np.int64)
    tops[place] = high[which]
    spread = tops - edges
    starts = np.cumsum(spread) - spread
    rows = np.arange(int(spread.sum())) - np.repeat(starts - edges, spread)
    least = np.minimum.reduceat(rank[index.locate(rows)], starts)
    late = rank[start[which]] > least[place]
    return segment[which[late]], offset[which[late]], longest[which[late]]


_MATCHED = "doc long, at long, matched int"


def _search(length: int):
    """Step 3, over candidates sorted by anchor, doc, at: _MATCHED, repeated windows with their ends' matching statistics; null where an occurrence before was as good."""

    def shard(rows: list[tuple]) -> pa.RecordBatch | None:
        docs = np.array([r[1] for r in rows], np.int64)
        ats = np.array([r[2] for r in rows], np.int64)
        pos, windows = ats >> 16, ats >> 8 & 255
        # Order of (document, place) as one number: equal places get equal numbers.
        order = np.lexsort((pos, docs))
        by_doc = np.cumsum(np.concatenate([[0], docs[order][1:] != docs[order][:-1]]))
        number = np.empty(len(rows), np.int64)
        number[order] = by_doc << 40
        key = number + pos
        segment, offset, longest = later_windows([r[3] for r in rows], key, windows, length)
        if not segment.size:
            return None
        return _batch(["doc", "at", "matched"], docs[segment], _pack(pos[segment] + offset, np.ones(segment.size, np.int64), np.zeros(segment.size, np.int64)), longest.astype(np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []  # whole anchors, then the anchor that may go on
        words, open_from = 0, 0
        for batch in pieces(batches, 8_000_000, "words"):
            at = batch.column(2).to_numpy()
            told = at < 0
            if told.any():
                n = int(told.sum())
                yield pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(told)), pa.array(-at[told] - 1), pa.nulls(n, pa.int32())], ["doc", "at", "matched"])
                batch = batch.filter(pa.array(~told))
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and row[0] != rows[-1][0]:
                    if words > SHARD_WORDS:
                        if (got := shard(rows)) is not None:
                            yield got
                        rows, words = [], 0
                    open_from = len(rows)
                elif words > 4 * SHARD_WORDS:
                    # More of one anchor than a shard takes: the first of each content stands for those before.
                    if (got := shard(rows)) is not None:
                        yield got
                    rows = list({r[3]: r for r in reversed(rows[open_from:])}.values())
                    rows.sort(key=lambda r: (r[1], r[2]))
                    words, open_from = sum(length + (r[2] >> 8 & 255) for r in rows), 0
                rows.append(row)
                words += length + (row[2] >> 8 & 255)
        if rows and (got := shard(rows)) is not None:
            yield got

    return run


def _numbered(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """(doc, text, id, carried): doc orders documents and differs where texts do. Ids serve as they are unless some are null or shared by different texts."""
    carried = F.struct(*[F.col(f"`{c}`").alias(c) for c in carry]) if carry else F.lit(None).cast("int")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), carried.alias("carried"))
    shared = base.groupBy("id").agg(F.min(F.xxhash64("text")).alias("a"), F.max(F.xxhash64("text")).alias("b")).where("id IS NULL OR a <> b")
    if shared.isEmpty():
        return base.select(F.col("id").alias("doc"), "text", "id", "carried")
    keys = base.select(F.col("id").alias("i"), F.xxhash64("text").alias("tie")).distinct()
    numbers = ranked(keys, [F.col("i").asc_nulls_last(), F.col("tie")]).withColumnRenamed("place", "doc")
    return base.join(numbers, base["id"].eqNullSafe(numbers["i"]) & (F.xxhash64("text") == F.col("tie"))).select("doc", "text", "id", "carried")


INTERVALS = T.ArrayType(T.StructType().add("first", T.IntegerType()).add("words", T.IntegerType()))


def _apply(length: int, verbatim: bool):
    """Step 4: (id, n_words, n_removed, kept, intervals, carried)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        interval = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))
        for batch in pieces(batches, 4_000_000):
            counts, removed, kept, found = [], [], [], []
            for text, spans in zip(byte_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words, runs = (text or b"").split(), []
                if spans:
                    at = np.array(spans, np.int64)
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at >> 16, 1)
                    np.add.at(edge, (at >> 16) + (at >> 8 & 255) + length - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    left = [words[k] for k in np.flatnonzero(~gone).tolist()]
                    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                    runs = [{"first": a, "words": b - a} for a, b in turns.tolist()]
                else:
                    left = None
                counts.append(len(words))
                removed.append(0 if left is None else len(words) - len(left))
                kept.append((text or b"") if left is None and verbatim else b" ".join(words if left is None else left))
                found.append(runs)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(found, interval), batch.column(3)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept", "intervals", "carried"])

    return run


def repeated(numbered: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, at, matched): repeated windows of (doc, text). at packs the first word's place and the number of windows; matched is the matching
    statistic of the window's end within its segment, null where two equal occurrences before told the repeat."""
    n = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = numbered.sparkSession.sparkContext.broadcast(common_grams(numbered, length, gram))
    found = numbered.select("doc", "text").mapInArrow(_find(length, gram, common), "anchor long, content long, doc long, at long")
    told = cut(found.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_tell, "kind byte, anchor long, doc long, at long"))
    wanted = told.where(F.col("kind") != REPEAT).groupBy("doc").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("at").alias("ats"), F.collect_list(F.col("kind").cast("long")).alias("kinds"))
    # A document's candidates are at most its windows. Rows of equal documents fetch the same, which count as one. All of their columns
    # go along, so that texts are dealt by document once, for this join and for that with the repeats.
    fetched = numbered.join(wanted, "doc").select("doc", "text", "anchors", "ats", "kinds", *[c for c in numbered.columns if c not in ("doc", "text")]).mapInArrow(_fetch(length), "anchor long, doc long, at long, words binary")
    searched = fetched.repartition(n, "anchor").sortWithinPartitions("anchor", "doc", "at").mapInArrow(_search(length), _MATCHED)
    return told.where(F.col("kind") == REPEAT).select("doc", "at", F.lit(None).cast("int").alias("matched")).unionByName(searched)


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, carry: list[str] = (), verbatim: bool = False) -> DataFrame:
    """Rows (id, n_words, n_removed, kept, intervals, carried), one for each row of docs; kept: the words left, joined by spaces; intervals: the runs
    of words removed; carried: the columns of `carry` in a struct, null without any.

    verbatim: texts that lose nothing stay as they are.
    """
    carry = list(carry)
    in_small_batches(docs.sparkSession)
    numbered = _numbered(docs, id_col, text_col, carry).where("doc IS NOT NULL")  # none is: said so that both joins deal out the same
    spans = repeated(numbered, length, gram).groupBy("doc").agg(F.collect_list("at").alias("spans"))
    joined = numbered.join(spans, "doc", "left").select("id", "text", "spans", "carried")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("intervals", INTERVALS), joined.schema["carried"]])
    return joined.mapInArrow(_apply(length, verbatim), schema)
