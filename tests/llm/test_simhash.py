import random

import numpy as np
import xxhash

from foliospark.llm import simhash


def plain(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(items):
    """Brute force: smallest id reachable."""
    n, root = len(items), list(range(len(items)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    fps = np.array([f for _, f in items], np.uint64)
    for k in range(n):
        for j in np.flatnonzero(np.bitwise_count(fps[k:] ^ fps[k]) <= 3) + k:
            root[max(find(k), find(j))] = min(find(k), find(j))
    least = {}
    for k, (i, _) in enumerate(items):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return {i: least.get(find(k)) for k, (i, _) in enumerate(items)}


def wide_classes(items):
    """Brute force over (id, text): smallest id reachable through pairs near in both fingerprints that share two bytes."""
    n, root = len(items), list(range(len(items)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    two, five = (np.array([plain(t, w) for _, t in items], np.uint64) for w in (2, 5))
    for k in range(n):
        x = two[k:] ^ two[k]
        shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)
        for j in np.flatnonzero((np.bitwise_count(x) <= 10) & (shared >= 2) & (np.bitwise_count(five[k:] ^ five[k]) <= 14)) + k:
            root[max(find(k), find(j))] = min(find(k), find(j))
    return [find(k) for k in range(n)]


def check(spark, rows):
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    items = [(r[0], plain(r[1])) for r in rows]
    want = classes(items)
    assert len(out) == len(rows)
    assert {(r.id, r.fp & (2**64 - 1), r.component_id) for r in out} == {(i, f, want[i]) for i, f in items}


def test_fingerprints():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 50, 199, 202, 203, 900):
        text = " ".join(rng.choice(["Abc", "é", "x,", "ÀB", "the"]) + str(rng.randint(0, 9)) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain(text)
    assert simhash.fingerprint("a\x0bB\x1cc d e".encode()) == plain("a\x0bB\x1cc d e")


def test_position_sets():
    assert len(simhash.BLOCKS) == 14
    from itertools import combinations

    assert all(sum(set(b) <= set(five) for b in simhash.BLOCKS) == 1 for five in combinations(range(8), 5))


def test_odd_rows(spark):
    check(spark, [(5, None, "a"), (3, "", "a"), (4, " \n", "a"), (9, "one two", "a"), (9, "one two", "a"), (2, "One  TWO", "a"), (None, "w " * 3000, "a")])
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_are_all_found(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for f in base:
        for _ in range(25):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
    items = [(k, f) for k, f in enumerate(sorted(fps))]
    frame = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for _, f in items], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame)).collect()}
    want = classes(items)
    groups, own = {}, {}
    for k, f in items:
        s = int(np.uint64(f).view(np.int64))
        groups.setdefault(want[k], set()).add(s)
        own.setdefault(roots.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


def test_long_lists():
    rng = random.Random(6)
    fps = np.array(sorted({rng.getrandbits(20) << 32 for _ in range(6000)}), np.uint64)
    short, long = simhash.LONG_LIST, 100

    def groups():
        root = {int(f): int(f) for f in fps}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a, more in simhash._list_links(simhash.BLOCKS.index((0, 1, 2, 3)), fps, 3):
            for b in more:
                x, y = find(int(a)), find(int(b))
                root[max(x, y)] = min(x, y)
        return {f: find(f) for f in root}

    a = groups()
    try:
        simhash.LONG_LIST = long
        assert groups() == a
    finally:
        simhash.LONG_LIST = short


def test_documents(spark):
    rows = [(r.doc_id, r.text, "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = classes([(r[0], plain(r[1])) for r in rows])
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == sorted(set(want.values()))


def test_one_row_of_each_class(spark):
    rng = random.Random(7)
    words = lambda k: " ".join(f"w{rng.randrange(10**6)}" for _ in range(40 + k))
    far = [words(k) for k in range(12)]
    # Classes of null ids only, one of them twice; an id that is the first of three classes; null copies of a class with an id.
    rows = [(None, t) for t in far[:5]] + [(None, far[0])] + [(7, t) for t in far[5:8]] + [(7, far[5]), (9, far[5])]
    rows += [(3, far[8]), (None, far[8]), (None, far[8]), (8, far[8]), (3, far[9]), (2, far[9]), (5, far[10]), (None, None), (None, " "), (6, far[11])]
    root = classes([(k, plain(t)) for k, (_, t) in enumerate(rows)])
    groups = {}
    for k, row in enumerate(rows):
        groups.setdefault(root[k], []).append(row)
    assert len(groups) == 13
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string").repartition(3)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    left = [(r.doc_id, r.text) for r in got.collect()]
    assert len(left) == len(groups)
    for group in groups.values():
        ids = [i for i, _ in group if i is not None]
        of = [r for r in left if r in group and r[0] == min(ids, default=None)]
        assert len(of) == 1


def test_wide_classes(spark):
    """Near copies with a word in twelve changed fall into one class; texts of the same words in another order do not."""
    rng = random.Random(9)
    rows = []
    for k in range(30):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(60, 300))]
        rows.append((100 * k, " ".join(words)))
        for j in range(1, 6):
            at = set(rng.sample(range(len(words)), len(words) // 30))
            rows.append((100 * k + j, " ".join(f"x{rng.randrange(400)}" if p in at else w for p, w in enumerate(words))))
        rng.shuffle(words)
        rows.append((100 * k + 9, " ".join(words)))
    rows += [(None, rows[0][1]), (5000, None), (5001, ""), (5001, ""), (5002, "one two"), (5003, "one  TWO")]
    root = wide_classes(rows)
    left = sorted(((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), wide=True).collect()), key=str)
    assert left == sorted((rows[min((k for k in range(len(rows)) if root[k] == c), key=lambda k: (rows[k][0] is None, rows[k][0]))] for c in set(root)), key=str)
    ids = {i for i, _ in left}
    assert sum(100 * k + j not in ids for k in range(30) for j in range(1, 6)) > 130 and all(100 * k + 9 in ids for k in range(30))


def test_wide_lists():
    """Many copies of few fingerprints link to one each."""
    rng = np.random.default_rng(3)
    fps = rng.integers(0, 2**63, 300, np.uint64)
    nodes = np.arange(300)
    near = list(simhash.wide_forest(nodes, np.concatenate([fps[:10]] * 30), np.concatenate([fps[:10]] * 30)))
    assert sum(b.size for _, b in near) == 290


def test_wide_recall(spark):
    """Of pairs of sf0.01 whose five-word shingles are alike by 0.8 or more, nine in ten are in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    by = {}
    for k, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(k)
    pairs = {(v[0], k) for v in by.values() if len(v) < 50 for k in v[1:]}
    alike = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = wide_classes(rows)
    assert len(alike) > 20 and sum(root[a] == root[b] for a, b in alike) >= 0.9 * len(alike)
    kept = {r.doc_id for r in simhash.keep_one(docs, wide=True).collect()}
    assert kept == {rows[c][0] for c in set(root)}
