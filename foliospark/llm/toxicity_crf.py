"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only documents are labelled, so token labels come first: over one document of each group of copies in a
bounded sample, a word or word beginning marks its tokens as toxic if it hardly occurs in clean ones and
chance would not put it into so many toxic ones, however many words are tried. On these tokens a two-state
chain is fitted: features of a word (itself, its beginnings and its end) weigh for the toxic state, a
matrix weighs the transitions. A text is one chain from its first word to its last; forward-backward gives each
word's probability of being toxic. For speed the chain is worked off in pieces of 64 words, all pieces of a batch at
once: the odds at a piece's end are a fractional linear function of those at its start, so pieces are first reduced to
their function, these are joined along the text, and then each piece is worked off from the odds it really starts with.
A document's score is a logistic function of the largest and the summed probabilities; words of a half or more are
reported with their offsets.

Fitting reads at most `rows` toxic and twice as many clean labelled documents of up to `longest` characters, each
whole and with all its words; both are parameters of train().

Defined results: null is the empty text, and empty texts get the score of a text without toxic words;
repeated rows each keep a row; a null id is held out; with labels of one class only, or none, every score
is that share (0 without labels); labels that are null are not used; extra columns are ignored, or carried in a struct
whatever they are called.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, carried, pieces

PIECE = 64
#: Weights below this are dropped.
LEAST_WEIGHT = 0.02
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„’‘…¡¿—–"
SPANS = T.ArrayType(T.StructType().add("first", T.IntegerType()).add("last", T.IntegerType()).add("probability", T.DoubleType()))


def parts(word: str) -> list[str]:
    """The features of a word in lower case."""
    core = word.strip(_EDGE) or word
    whole = core if len(core) <= 40 else xxhash.xxh128_hexdigest(core.encode("utf-8", "replace"))
    return ["w" + whole, *(f"{n}{core[:n]}" for n in (3, 4, 5, 6) if len(core) > n), "e" + core[-4:]]


@dataclass
class Crf:
    weights: dict[str, float]  # of the features, for the toxic state
    bias: float
    step: np.ndarray  # [from, to] log weights
    head: tuple[float, float, float]  # the document's log-odds: constant, largest, log of the sum

    def emission(self, word: str) -> float:
        found = self.weights.get
        return self.bias + sum([found(p, 0.0) for p in parts(word)])


class Chains:
    """Texts of `sizes` words, one behind the other, as pieces that are worked off together."""

    def __init__(self, sizes: np.ndarray):
        n = -(-sizes // PIECE)
        self.words = int(sizes.sum())
        owner = np.repeat(np.arange(sizes.size), n)
        self.number = np.arange(owner.size) - np.repeat(np.cumsum(n) - n, n)  # of a piece in its text
        self.first = (np.cumsum(sizes) - sizes)[owner] + self.number * PIECE
        self.size = np.minimum(PIECE, sizes[owner] - self.number * PIECE)
        self.last = self.number == n[owner] - 1
        self.order = np.argsort(-self.size, kind="stable")
        self.active = np.searchsorted(-self.size[self.order], -np.arange(PIECE), "left").tolist() if owner.size else [0] * PIECE
        #: Pieces by their number in the text, those of one number together.
        self.levels = np.split(np.argsort(self.number, kind="stable"), np.cumsum(np.bincount(self.number))[:-1]) if owner.size else []

    def forward(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Odds of the toxic state from the words up to each. x: odds of emission, t: weights of transitions."""
        out, entry = np.empty(self.words), np.zeros(self.first.size)
        if len(self.levels) > 1:
            # What a whole piece makes of odds r: (a r + b) / (c r + d).
            whole = np.flatnonzero(~self.last)
            a, b, c, d = np.ones(whole.size), np.zeros(whole.size), np.zeros(whole.size), np.ones(whole.size)
            for k in range(PIECE):
                y = x[self.first[whole] + k]
                a, b, c, d = y * (t[1, 1] * a + t[0, 1] * c), y * (t[1, 1] * b + t[0, 1] * d), t[1, 0] * a + t[0, 0] * c, t[1, 0] * b + t[0, 0] * d
                most = np.maximum(np.maximum(a, b), np.maximum(c, d))
                a, b, c, d = a / most, b / most, c / most, d / most
            of = np.full(self.first.size, -1)
            of[whole] = np.arange(whole.size)
            begins = self.levels[0]
            r = self._run(x, t, begins, np.zeros(begins.size), out=None)
            entry[begins[~self.last[begins]] + 1] = r[~self.last[begins]]
            for level in self.levels[1:]:
                on = level[~self.last[level]]
                w, r = of[on], entry[on]
                entry[on + 1] = (a[w] * r + b[w]) / (c[w] * r + d[w])
        self._run(x, t, np.arange(self.first.size), entry, out)
        return out

    def _run(self, x: np.ndarray, t: np.ndarray, which: np.ndarray, entry: np.ndarray, out: np.ndarray | None) -> np.ndarray:
        """Odds at the ends of the pieces `which` that start behind odds `entry`; those of all words go to out."""
        order = which[np.argsort(-self.size[which], kind="stable")]
        back = np.empty(self.first.size, np.int64)
        back[which] = np.arange(which.size)
        r = entry[back[order]]
        begins, first, size = self.number[order] == 0, self.first[order], self.size[order]
        for k, m in enumerate(np.searchsorted(-size, -np.arange(PIECE), "left").tolist()):
            if not m:
                break
            y = x[first[:m] + k]
            step = y * (t[0, 1] + r[:m] * t[1, 1]) / (t[0, 0] + r[:m] * t[1, 0])
            r[:m] = np.where(begins[:m], y, step) if k == 0 else step
            if out is not None:
                out[first[:m] + k] = r[:m]
        ends = np.empty(which.size)
        ends[back[order]] = r
        return ends

    def backward(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """The factor by which the words behind each change its odds."""
        out, entry = np.empty(self.words), np.ones(self.first.size)
        if len(self.levels) > 1:
            later = np.flatnonzero(self.number > 0)  # these hand their factor on to the piece before
            later = later[np.argsort(-self.size[later], kind="stable")]
            a, b, c, d = np.ones(later.size), np.zeros(later.size), np.zeros(later.size), np.ones(later.size)
            for k in range(PIECE - 1, -1, -1):
                m = int(np.searchsorted(-self.size[later], -k, "left"))
                if not m:
                    continue
                y = x[self.first[later[:m]] + k]
                p, q, u, v = a[:m] * y, b[:m] * y, c[:m].copy(), d[:m].copy()
                p, q, u, v = t[1, 1] * p + t[1, 0] * u, t[1, 1] * q + t[1, 0] * v, t[0, 1] * p + t[0, 0] * u, t[0, 1] * q + t[0, 0] * v
                most = np.maximum(np.maximum(p, q), np.maximum(u, v))
                a[:m], b[:m], c[:m], d[:m] = p / most, q / most, u / most, v / most
            of = np.full(self.first.size, -1)
            of[later] = np.arange(later.size)
            for level in reversed(self.levels[1:]):
                w, r = of[level], entry[level]
                entry[level - 1] = (a[w] * r + b[w]) / (c[w] * r + d[w])
        order, first, size = self.order, self.first[self.order], self.size[self.order]
        r = entry[order]
        for k in range(PIECE - 1, -1, -1):
            m, beyond = self.active[k], self.active[k + 1] if k + 1 < PIECE else 0
            if beyond:
                y = x[first[:beyond] + k + 1] * r[:beyond]
                r[:beyond] = (t[1, 0] + t[1, 1] * y) / (t[0, 0] + t[0, 1] * y)
            out[first[:m] + k] = r[:m]
        return out


def marginals(e: np.ndarray, step: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
    """(probability of the toxic state, odds from the words up to it) of every word. e: log-odds of emission."""
    x, t = np.exp(np.clip(e, -25, 25)), np.exp(step)
    odds = chains.forward(x, t)
    both = odds * chains.backward(x, t)
    return both / (1 + both), odds


class Tagger:
    def __init__(self, crf: Crf):
        self.crf = crf
        self.emissions = Memo(crf.emission)

    def probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(of every word of the texts in order, words of each text)."""
        sizes, flat = np.zeros(len(texts), np.int64), []
        for k, t in enumerate(texts):
            if t:
                before = len(flat)
                flat += t.lower().split()
                sizes[k] = len(flat) - before
        e = np.fromiter(map(self.emissions.__getitem__, flat), np.float64, len(flat))
        return marginals(e, self.crf.step, Chains(sizes))[0], sizes

    def scores(self, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        most, total = pooled(p, sizes)
        a, b, c = self.crf.head
        return 1 / (1 + np.exp(-np.clip(a + b * most + c * np.log1p(total), -30, 30)))

    def tag(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[dict]]]:
        """(score, spans) of each text; a span: offsets of its first and behind its last character, its words' largest probability."""
        p, sizes = self.probabilities(texts)
        score, spans, start = self.scores(p, sizes), [], 0
        for t, n in zip(texts, sizes.tolist(), strict=True):
            own = p[start : start + n]
            start += n
            hit = own >= 0.5
            if not hit.any():
                spans.append([])
                continue
            found, last = [], -2
            # Lower case can change lengths, so words are counted in the text itself.
            for k, m in enumerate(re.finditer(r"\S+", t)):
                if k < n and hit[k]:
                    if last == k - 1:
                        found[-1] |= {"last": m.end(), "probability": max(found[-1]["probability"], float(own[k]))}
                    else:
                        found.append({"first": m.start(), "last": m.end(), "probability": float(own[k])})
                    last = k
            spans.append(found)
        return score, spans


def pooled(p: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The largest probability and the sum of those of 0.1 or more, of each text."""
    owner = np.repeat(np.arange(sizes.size), sizes)
    most = np.zeros(sizes.size)
    np.maximum.at(most, owner, p)
    return most, np.bincount(owner, np.where(p >= 0.1, p, 0.0), minlength=sizes.size)


def _one_of_copies(rows: list[np.ndarray]) -> list[int]:
    """Indices of texts (numbers of their words) that share none of their two smallest shingle hashes with one before."""
    seen, out = set(), []
    for k, words in enumerate(rows):
        h = np.zeros(max(1, words.size - 3), np.uint64)
        for j in range(min(4, words.size)):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + words[j : j + h.size].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        least = np.unique((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93))[:2].tolist()
        if not seen.intersection(least):
            out.append(k)
        seen.update(least)
    return out


@dataclass
class Vocabulary:
    """Words and features by number: those of word w stand at starts[w] to starts[w + 1] of `features`."""

    names: list[str]
    features: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, words: Iterable[str]) -> Vocabulary:
        index: dict[str, int] = {}
        lists = [[index.setdefault(p, len(index)) for p in parts(w)] for w in words]
        return cls(list(index), np.fromiter((i for x in lists for i in x), np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]))

    def of_words(self, words: np.ndarray) -> np.ndarray:
        """The features of some words, one behind the other."""
        size = self.starts[words + 1] - self.starts[words]
        return self.features[np.repeat(self.starts[words] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def telling(rows: list[np.ndarray], vocabulary: Vocabulary, toxic: np.ndarray) -> np.ndarray:
    """Whether each feature marks a token as toxic. rows: numbers of each text's words."""
    counts, n = np.zeros((2, len(vocabulary.names)), np.int64), [0, 0]
    for k in _one_of_copies(rows):
        n[int(toxic[k])] += 1
        counts[int(toxic[k])][np.unique(vocabulary.of_words(np.unique(rows[k])))] += 1
    counts[:, np.fromiter((p[0] == "e" for p in vocabulary.names), bool, len(vocabulary.names))] = 0  # a word's end alone tells nothing
    scale, share = n[1] / max(1, n[0]), n[1] / max(1, sum(n))
    tried = np.sort(counts.sum(0)[counts[1] > 0])
    # All of m documents toxic by chance: share ** m, for each of the features as frequent.
    chance = lambda m: share**m * (tried.size - np.searchsorted(tried, m))
    least = next((m for m in range(3, 200) if chance(m) <= 0.01), 200)
    return (counts[1] >= least) & (counts[0] * scale <= 0.02 * counts[1])


def fit(texts: list[str | None], toxic: np.ndarray, rounds: int = 30, rate: float = 0.5, pull: float = 1e-4) -> Crf:
    """A model of labelled texts, of all their words."""
    texts = [(t or "").lower() for t in texts]
    zero = Crf({}, -20.0, np.zeros((2, 2)), (-30.0, 0.0, 0.0))
    share = float(np.mean(toxic)) if len(texts) else 0.0
    if share in (0.0, 1.0):
        zero.head = (30.0 if share else -30.0, 0.0, 0.0)
        return zero
    number: dict[str, int] = {}
    rows = [np.fromiter((number.setdefault(w, len(number)) for w in t.split()), np.int64) for t in texts]
    sizes, word = np.array([r.size for r in rows], np.int64), np.concatenate(rows).astype(np.int32)
    known = Vocabulary.of(number)
    m, of = len(number), np.repeat(np.arange(len(number)), np.diff(known.starts))
    ids = known.features
    marked = np.bincount(of, telling(rows, known, toxic)[ids], m) > 0
    y = (marked[word] & np.repeat(toxic.astype(bool), sizes)).astype(float)
    chains = Chains(sizes)
    # Words with one behind them in their text.
    pair = np.delete(np.arange(word.size), np.cumsum(sizes)[sizes > 0] - 1)
    seen = np.bincount((2 * y[pair] + y[pair + 1]).astype(int), minlength=4).reshape(2, 2)
    w, bias, step = np.zeros(len(known.names)), -3.0, np.zeros((2, 2))
    gw, gb, gs = np.full(w.size, 1e-6), 1e-6, np.full((2, 2), 1e-6)
    scale = 1000 / max(1, y.size)
    for _ in range(rounds):
        p, odds = marginals((bias + np.bincount(of, w[ids], m))[word], step, chains)
        slope = (y - p) * scale
        dw = np.bincount(ids, np.bincount(word, slope, m)[of], w.size) - pull * w
        db, ds = float(slope.sum()), (seen - _pairs(odds[pair], p[pair + 1], step)) * scale - pull * step
        gw, gb, gs = gw + dw**2, gb + db**2, gs + ds**2
        w += rate * dw / np.sqrt(gw)
        bias += rate * db / np.sqrt(gb)
        step += rate * ds / np.sqrt(gs)
    held = np.flatnonzero(np.abs(w) >= LEAST_WEIGHT)
    crf = Crf({known.names[k]: float(w[k]) for k in held.tolist()}, float(bias), step, (0.0, 0.0, 0.0))
    # The head is fitted to what the tagger will say, which drops small weights.
    kept = np.zeros(w.size)
    kept[held] = w[held]
    crf.head = _head(*pooled(marginals((bias + np.bincount(of, kept[ids], m))[word], step, chains)[0], sizes), toxic)
    return crf


def _pairs(odds: np.ndarray, after: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Expected numbers of the four transitions: of a right neighbour's states (probability `after`), where they came from."""
    t = np.exp(step)
    from_toxic = [odds * t[1, j] / (t[0, j] + odds * t[1, j]) for j in (0, 1)]
    return np.array([[((1 - from_toxic[j] if i == 0 else from_toxic[j]) * (1 - after if j == 0 else after)).sum() for j in (0, 1)] for i in (0, 1)])


def _head(most: np.ndarray, total: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small pull to zero, by Newton's method."""
    x = np.stack([np.ones(len(y)), most, np.log1p(total)], 1)
    b, pull = np.zeros(3), np.diag([1e-3, 5e-2, 5e-2])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ b)
    return tuple(map(float, b))


def train(docs: DataFrame, labels: DataFrame, usable, label_col: str = "toxic", rows: int = 1000, longest: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """A model of up to `rows` toxic and twice as many clean labelled documents, of which those over `longest` characters are left out. usable: the condition on label rows that may be learned from.

    Of rows that share an id one stands for all.
    """
    known = labels.where(usable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("y"))
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(text_col, F.lit("")).alias("text"))
    by = [F.xxhash64("__id"), F.col("__id")]
    some = known.where("y = 1").orderBy(*by).limit(rows).unionByName(known.where("y = 0").orderBy(*by).limit(2 * rows))  # bounded: small enough to broadcast
    got = texts.where(F.length("text") <= longest).join(F.broadcast(some), "__id").groupBy("__id").agg(F.min("text").alias("text"), F.min("y").alias("y")).toArrow()
    order = sorted(zip(got.column("text").to_pylist(), got.column("y").to_pylist(), strict=True))
    return fit([t for t, _ in order], np.array([y for _, y in order], float))


def score(docs: DataFrame, crf: Crf, keep: list[str], text_col: str = "text") -> DataFrame:
    """Rows (carried, score, spans), one for each row of docs; carried: the columns of `keep` in a struct."""
    held = docs.sparkSession.sparkContext.broadcast(crf)  # bounded by the words of the sample
    kept = docs.select(carried(keep), F.col(text_col).alias("text"))
    schema = kept.drop("text").schema.add("score", "double").add("spans", SPANS)
    span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = None
        for batch in pieces(batches, 3_000_000):
            tagger = tagger or Tagger(held.value)
            scores, spans = tagger.tag(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(spans, span)], ["carried", "score", "spans"])

    return kept.mapInArrow(run, schema)
