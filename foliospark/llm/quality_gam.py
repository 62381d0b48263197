"""Document quality by a generalised additive model with pairwise interactions.

The log-odds of quality are a sum of lookup tables: one over the bins of each feature and one over the
bin pairs of the strongest feature pairs. Tables are learned by cyclic boosting: round after round each
feature in turn gets a shallow tree on its own bins fitted to the current residuals; with the main
effects fixed, the pairs that would lower the loss most are chosen on coarse bins and boosted the same
way. A document is scored by adding the table entries of its bins, all documents of a batch at once.

Features are read from the whole text. Fitting uses at most `rows` labelled documents (those of the
smallest hash of their id), a parameter.

Defined results: null is the empty text, and empty texts are scored like any other; repeated rows each
keep a row; a null id is held out; with labels of one class only, or none, every score is that share
(0.5 without labels); labels that are null are not used; extra columns are ignored, or carried in a struct whatever
they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_texts, carried, pieces

FEATURES = [
    "log_bytes", "log_words", "mean_word", "upper_share", "digit_share", "high_share", "space_share", "line_share",
    "stop_share", "comma_share", "bang_share", "bar_share", "mark_share", "bracket_share", "quote_share", "url_share",
    "distinct_words", "distinct_triples", "distinct_lines", "longest_word", "ended_lines", "control_share",
]
BINS, COARSE = 24, 6


def _set(chars: bytes) -> np.ndarray:
    found = np.zeros(256, np.int64)
    found[list(chars)] = 1
    return found


_CLASSES = np.stack([
    _set(bytes(range(65, 91))), _set(b"0123456789"), _set(bytes(range(0xC2, 0xF5))), _set(b" \t"), _set(b"\n"), _set(b"."), _set(b","), _set(b"!?"),
    _set(b"|"), _set(b"#*$%&<>"), _set(b"()[]{}"), _set(b"\"'`"), _set(b"/@_="), _set(bytes([*range(9), *range(14, 32), 127])), _set(bytes(range(97, 123))),
])


def features(text: bytes | None) -> list[float]:
    """The values of FEATURES."""
    text = text or b""
    upper, digit, high, space, line, stop, comma, bang, bar, mark, bracket, quote, url, control, lower = (_CLASSES @ np.bincount(np.frombuffer(text, np.uint8), minlength=256)).tolist()
    words = text.split()
    n, size = len(words), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    return [
        np.log1p(len(text)), np.log1p(n), (upper + lower + high) / max(1, n), upper / max(1, upper + lower), digit / size, high / size, space / size, line / size,
        stop / max(1, n), comma / max(1, n), bang / max(1, n), bar / max(1, n), mark / max(1, n), bracket / max(1, n), quote / max(1, n), url / max(1, n),
        len(set(words)) / max(1, n), len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, n - 2), len(set(lines)) / m,
        max(map(len, words), default=0), sum(x.rstrip()[-1:] in b".!?:;" for x in lines) / m, control / size,
    ]


@dataclass
class Gam:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    mains: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.mains):
            total += table[b[:, k]]
        for (i, j), table in self.pairs.items():
            total += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(v: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins of about equal numbers of documents."""
    return np.unique(np.quantile(v, np.arange(1, bins) / bins, method="higher")) if v.size else v


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """A table over bins: the shallow tree that splits best again and again, up to `leaves` leaves."""
    cg, ch = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + smooth)
    parts = [(0, grad.size)]
    while len(parts) < leaves:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                cuts = np.arange(a + 1, b)
                won = gain(a, cuts) + gain(cuts, b) - gain(a, b)
                at = int(won.argmax())
                best = max(best, (float(won[at]), k, int(cuts[at])))
        if best[0] <= 1e-9:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(grad.size)
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + smooth)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray, smooth: float) -> tuple[np.ndarray, float]:
    """A table over two features' bins: one cut of each, four leaves, and what it gains."""
    cg, ch = (np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for t in (grad, hess))
    best, table = -1.0, np.zeros_like(grad)
    whole = cg[-1, -1] ** 2 / (ch[-1, -1] + smooth)
    for i in range(1, grad.shape[0]):
        for j in range(1, grad.shape[1]):
            cells = [(cg[i, j], ch[i, j]), (cg[i, -1] - cg[i, j], ch[i, -1] - ch[i, j]), (cg[-1, j] - cg[i, j], ch[-1, j] - ch[i, j])]
            cells.append((cg[-1, -1] - sum(c[0] for c in cells), ch[-1, -1] - sum(c[1] for c in cells)))
            gain = sum(g * g / (h + smooth) for g, h in cells) - whole
            if gain > best:
                v = [g / (h + smooth) for g, h in cells]
                best = gain
                table = np.empty_like(grad)
                table[:i, :j], table[:i, j:], table[i:, :j], table[i:, j:] = v
    return table, best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pairs: int = 8, pair_rounds: int = 60, rate: float = 0.1, smooth: float = 5.0) -> Gam:
    """The model of a feature matrix and labels 0 or 1."""
    share = float(y.mean()) if y.size else 0.5
    if share in (0.0, 1.0) or y.size < 2:
        return Gam(base=float(np.clip(np.log((share + 1e-9) / (1 - share + 1e-9)), -30, 30)))
    gam = Gam(base=float(np.log(share / (1 - share))), edges=[_edges(x[:, k], BINS) for k in range(x.shape[1])])
    b = gam.bins(x)
    width = [e.size + 1 for e in gam.edges]
    gam.mains = [np.zeros(w) for w in width]
    gam.coarse = [np.arange(w) * min(w, COARSE) // w for w in width]
    total = np.full(y.size, gam.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, w in enumerate(width):
            if w > 1:
                g, h = slopes()
                step = rate * _tree(np.bincount(b[:, k], g, w), np.bincount(b[:, k], h, w), 4, smooth)
                gam.mains[k] += step
                total += step[b[:, k]]
    c = np.stack([gam.coarse[k][b[:, k]] for k in range(b.shape[1])], 1)
    size = [min(w, COARSE) for w in width]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        at = c[:, i] * size[j] + c[:, j]
        return tuple(np.bincount(at, v, size[i] * size[j]).reshape(size[i], size[j]) for v in (g, h))

    ranked = sorted(((_pair_tree(*cells(i, j), smooth)[1], i, j) for i, j in combinations(range(len(width)), 2) if size[i] > 1 and size[j] > 1), reverse=True)
    chosen = [(i, j) for _, i, j in ranked[:pairs]]
    gam.pairs = {p: np.zeros((size[p[0]], size[p[1]])) for p in chosen}
    for _ in range(pair_rounds):
        for i, j in chosen:
            step = rate * _pair_tree(*cells(i, j), smooth)[0]
            gam.pairs[i, j] += step
            total += step[c[:, i], c[:, j]]
    return gam


def matrix(texts: list[bytes | None]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def training_set(docs: DataFrame, labels: DataFrame, label_col: str, usable, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text, y) of the bounded sample: usable labels of the smallest id hashes, joined to their texts."""
    some = labels.where(usable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("y"))
    some = some.orderBy(F.xxhash64("__id"), "__id", "y").limit(rows)  # at most `rows` rows: small enough to broadcast
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(F.broadcast(some), "__id")


def train(docs: DataFrame, labels: DataFrame, usable, label_col: str = "quality", rows: int = 12_000) -> Gam:
    """A model of labelled documents. usable: the condition on label rows that may be learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = matrix(byte_texts(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["y", "x"])

    got = training_set(docs, labels, label_col, usable, rows).select("text", "y").mapInArrow(run, "y double, x array<double>").toArrow()
    y = got.column("y").to_numpy()
    x = np.array(got.column("x").to_pylist(), float).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y))  # the same model whatever order rows came in
    return fit(x[order], y[order])


def assess(docs: DataFrame, gam: Gam, keep: list[str], text_col: str = "text") -> DataFrame:
    """Rows (carried, score), one for each row of docs; carried: the columns of `keep` in a struct."""
    kept = docs.select(carried(keep), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gam.score(matrix(byte_texts(batch.column(1)))))], ["carried", "score"])

    return kept.mapInArrow(run, kept.drop("text").schema.add("score", "double"))
