import math
import random

import numpy as np
import pytest

from foliospark.llm import hard_negatives
from foliospark.llm.hard_negatives import _HIGH, _LOW, Search, scores


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    """rows: (id, label, vector); all pairs in whole numbers."""
    sound = []
    for i, label, v in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            sound.append((i, label, [int(math.floor(256 * x)) for x in v]))
    dot = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=False)), _LOW), _HIGH)
    out = []
    for k, (i, label, v) in enumerate(sound):
        if i is None or i % every:
            continue
        found = [(-dot(v, w), j is None, j or 0, other == label, j) for m, (j, other, w) in enumerate(sound) if m != k]
        found.sort(key=lambda f: f[:3])
        for p, *_, pid in [f for f in found if f[3]][:positives]:
            fit = [f for f in found if not f[3] and 10 * -p * low // 10 <= 100 * -f[0] <= -p * high]
            out += [(i, pid, rank, f[4], -p, -f[0]) for rank, f in enumerate(fit[:negatives], 1)]
    return out


def check(spark, rows, **kw):
    got = hard_negatives.mine(spark.createDataFrame([(*r, "x") for r in rows], "id long, label int, vector array<double>, v string").repartition(3), **kw).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows, **kw), key=key)
    return got


def clustered(rng, n, dim=6, spread=0.05):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    return [(k, rng.randrange(3), [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for k in range(n)]


@pytest.mark.parametrize("size", [4, 64, 2048])
def test_against_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(hard_negatives, "SIZE", size)
    monkeypatch.setattr(hard_negatives, "GROUP", 5)
    monkeypatch.setattr(hard_negatives, "SLICE", 3)
    rng = random.Random(size)
    assert len(check(spark, clustered(rng, 400), every=10)) > 500


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "SIZE", 8)
    rng = random.Random(4)
    rows = clustered(rng, 60)
    same = (100, 1, [0.5, 0.25, 0.1, -0.2, 0.3, 0.7])
    rows += [same] * 25 + [(None, 1, same[2]), (None, 2, same[2]), (None, 2, same[2]), (200, 2, same[2]), (7, 2, same[2])]  # repeated anchors, ties, null ids
    rows += [(300, None, same[2]), (300, 1, None), (300, 1, [1.0, None]), (300, 1, [float("nan")]), (300, 1, [float("inf")] * 6), (300, 1, [1e308])]
    rows += [(400, 1, []), (401, 2, []), (500, 1, [0.4, 0.3]), (-100, 1, [0.3] * 9), (600, 2, [-x for x in same[2]]), (0, 2, [1e14, 1e14]), (1, 1, [1e14, -3e13]), (2, 2, [3e13, 5e13])]
    check(spark, rows)
    assert hard_negatives.mine(spark.createDataFrame([], "id long, label int, vector array<float>")).count() == 0
    check(spark, [(100, 1, [1.0])])


def test_scores_are_exact():
    big = np.floor(np.array([[3.0e9 + 1, 7.0, -1.0], [2.0**60, 2.0**60, 5.0]]))
    want = [[min(max(sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), _LOW), _HIGH) for b in big] for a in big]
    assert scores(big, big).tolist() == want
    assert scores(np.zeros((2, 0)), big).tolist() == [[0, 0], [0, 0]]


def test_node_pairs_are_pruned(monkeypatch):
    """With clusters, few leaf pairs are scored, and the best are those of all."""
    monkeypatch.setattr(hard_negatives, "FEW", 16)
    monkeypatch.setattr(hard_negatives, "PART", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (40, 8)) * 200
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 3, (4000, 8)))
    labels = rng.integers(0, 4, 4000)
    near = np.argsort(x[:, 0], kind="stable")[:600]
    row = {"n": 600, "matrix": x[near].tobytes(), "labels": labels[near], "home": np.zeros(600, int), "at": near, "low": np.full((600, 1), _LOW).tobytes(), "high": np.full((600, 1), _HIGH).tobytes()}
    found = Search(row, True, 5)
    found.meet({"n": 4000, "matrix": x.tobytes(), "labels": labels, "ids": list(range(4000)), "block": 0})
    assert found.scored < 0.25 * len(leaves(found.root)) * len(leaves(hard_negatives.Node(x, np.arange(4000), 64)))
    s = (x[near] @ x.T).astype(np.int64)
    for k, i in enumerate(near):
        order = sorted((-v, j) for j, v in enumerate(s[k].tolist()) if j != i and labels[j] == labels[i])[:5]
        assert [(-a, b) for a, b in zip(found.score[k, 0].tolist(), found.id[k, 0].tolist(), strict=True)] == order


def leaves(node):
    return [x for c in node.children for x in leaves(c)] if node.children else [node]


def test_query(spark):
    from foliospark.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        rows.append((r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding))
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, sf).collect()) == sorted(brute(rows))
