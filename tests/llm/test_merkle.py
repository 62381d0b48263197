import random
import zlib
from hashlib import sha256

import pytest

from foliospark.llm import merkle, queries
from foliospark.llm.merkle import F

H = lambda *x: sha256("".join(x).encode()).hexdigest()


def levels(nodes):
    """All levels of a tree, written down whole."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    found = []
    for level in tree[:-1]:
        if (at ^ 1) < len(level):
            found.append((at & 1, level[at ^ 1]))
        else:
            found.append((0, ""))
        at >>= 1
    return found


def brute(rows):
    """rows: (grp, id, leaf, other) -> (grp, id, leaf, subroot, root, proof, folded)."""
    order = lambda r: (r[1] is not None, r[1] or 0, r[2])
    groups = {}
    for r in sorted(rows, key=order):
        groups.setdefault(r[0], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([r[2] for r in groups[g]]) for g in names]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(names):
        for at, (_, i, leaf, other) in enumerate(groups[g]):
            way = siblings(trees[k], at) + siblings(top, k)
            now = other or leaf
            for left, s in way:
                now = H(s, now) if left else H(now, s)
            out.append((g, i, leaf, trees[k][-1][0], top[-1][0], H(*[s for _, s in way]), now))
    return out


@pytest.mark.parametrize("subtree", [1, 2, 3, 5])
def test_fractal_traversal(subtree):
    for n in (1, 2, 3, 4, 5, 7, 8, 9, 31, 32, 33, 64, 100):
        nodes = [H(str(k)) for k in range(n)]
        tree = levels(nodes)
        got = list(merkle.paths([x.encode() for x in nodes], merkle.height_of(n, 12), subtree))
        assert [[("L" if left else "R" if s else "", s.encode()) for left, s in siblings(tree, k)] for k in range(n)] == got
        assert merkle.root_of([x.encode() for x in nodes], merkle.height_of(n, 12)).decode() == tree[-1][0]


def test_traversal_holds_few_nodes():
    held = []
    nodes = [H(str(k)).encode() for k in range(1 << 12)]

    class Watched(merkle.Growing):
        def grow(self, steps):
            super().grow(steps)
            held.append(len(self.nodes) + len(self.stack))

    own, merkle.Growing = merkle.Growing, Watched
    try:
        for _ in merkle.paths(nodes, 12):
            pass
    finally:
        merkle.Growing = own
    # Each of the stacked subtrees has 2 ** 5 nodes at most, and a stack of its height.
    assert max(held) <= 2 * (1 << merkle.SUBTREE) + 13


@pytest.mark.parametrize("block", [1, 2, 3, 12])
def test_proofs(spark, block):
    rng = random.Random(block)
    rows = [(rng.choice([None, "", "en", "é", "zz", "zz", "zz", "zz", f"l{k % 9}"]), rng.choice([None, k % 50, -k, k]), H(str(rng.randrange(150))), H("x", str(k)) if k % 5 == 0 else None) for k in range(220)]
    rows += [("zz", 5, H("same"), None)] * 30
    got = merkle.proofs(spark.createDataFrame(rows, "grp string, id long, leaf string, other string").repartition(3), block=block).collect()
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    # Rows alike in group, id and leaf may change places, and with them the leaf that is tried.
    alike = {k for k in {r[:3] for r in rows} if len({r[3] for r in rows if r[:3] == k}) > 1}
    cols = lambda rs: sorted((tuple(r) for r in rs if tuple(r)[:3] not in alike), key=key)
    assert cols((r.grp, r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got) == cols(brute(rows))
    assert len(got) == len(rows)
    for r in got:
        assert r.proof_sha256 == H(*[s[1:] for s in r.path])


def test_lone_rows_and_none(spark):
    schema = "grp string, id long, leaf string, other string"
    one = merkle.proofs(spark.createDataFrame([(None, None, H("a"), None)], schema)).collect()
    assert [(r.grp, r.id, r.root, r.folded_root, r.proof_sha256, r.path) for r in one] == [(None, None, H("a"), H("a"), H(""), [])]
    assert merkle.proofs(spark.createDataFrame([], schema)).count() == 0


def test_leaves(spark):
    rows = [(1, None, "é:", 3), (None, "", "-", None), (1, None, "é:", 3)]
    got = [r[0] for r in spark.createDataFrame(rows, "a long, b string, c string, d long").select(merkle.leaf(*map(F.col, "abcd"))).collect()]
    assert got == [H("1:1", "-", "3:é:", "1:3"), H("-", "0:", "1:-", "-"), H("1:1", "-", "3:é:", "1:3")]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    part = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    rows = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        leaf = lambda n, r=r: H(*map(part, (r.doc_id, r.source, r.lang, n, r.text)))
        rows.append((r.lang, r.doc_id, leaf(r.n_chars), leaf(r.n_chars + 1) if zlib.crc32(str(r.doc_id).encode()) % 7 == 0 else None))
    got = queries.op11_merkle(spark, sf).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in got) == sorted((*r[1:], r[-1] == r[-3]) for r in brute(rows))
    assert 0 < sum(not r.verified for r in got) < len(got) / 5
