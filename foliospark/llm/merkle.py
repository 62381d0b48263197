"""A Merkle manifest of a dataset: a tree for each group over its leaves in order, and a tree over the groups' roots.

Every two consecutive nodes become the hash of both, a last one alone the hash of itself, until one is left; a lone
leaf is its own root. Digests are SHA-256 as lower-case hex text, and hashes of hashes are over that text.

Positions of leaves are counted over sorted ranges. A group's leaves are then dealt out in aligned blocks of 2 ** BLOCK,
which become a node each of the tree above; that is again dealt out in blocks, until each group has one node. A block's
authentication paths come one after another by fractal traversal: of the path of the current leaf it holds one
existing subtree at each of a few stacked levels, and while those are used the desired subtrees, their right neighbours, grow by two
nodes a leaf, so that each is ready when its turn comes. A task holds a block's leaves and these subtrees, however many
leaves a group has. What stands above a block is appended to its paths.

Defined results: nulls in a field are `-`; rows come by id, null ids first, rows of one id by their leaf; repeated rows each
have a place and a proof; a null group is one of its own and comes first; no rows give no rows; extra columns are not in the leaf,
whatever they are called; the manifest of one leaf has the leaf as its root and an empty proof.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Height of a block, and of the subtrees that its traversal stacks.
BLOCK, SUBTREE = 12, 4
#: Offsets of so many parts and groups are broadcast; more are joined.
BROADCAST = 100_000


def encoded(*fields: Column) -> Column:
    """Each field as UTF-8 byte count, `:` and value, `-` if null."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def leaf(*fields: Column) -> Column:
    return F.sha2(encoded(*fields).cast("binary"), 256)


def _hashed(left: bytes | None, right: bytes | None) -> bytes | None:
    """The parent of two nodes, of which the right one or both may be missing."""
    return None if left is None else sha256(left + right if right else left).hexdigest().encode()


class Growing:
    """The subtree over the leaves from `start` on, 2 ** top of them, grown node by node; those at heights from `low` up to below `top` are kept."""

    def __init__(self, leaves: list[bytes], start: int, low: int, top: int):
        self.leaves, self.next, self.low, self.top = leaves, start, low, top
        self.stack: list[tuple[int, int, bytes | None]] = []
        self.nodes: dict[tuple[int, int], bytes] = {}
        self.left = (2 << top) - 2

    def grow(self, steps: int) -> None:
        for _ in range(min(steps, self.left)):
            if len(self.stack) > 1 and self.stack[-1][0] == self.stack[-2][0]:
                (height, at, a), (_, _, b) = self.stack[-2:]
                del self.stack[-2:]
                node = (height + 1, at >> 1, _hashed(a, b))
            else:
                node = (0, self.next, self.leaves[self.next] if self.next < len(self.leaves) else None)
                self.next += 1
            self.stack.append(node)
            if node[0] >= self.low and node[2]:
                self.nodes[node[:2]] = node[2]
            self.left -= 1


def height_of(n: int, block: int) -> int:
    """The height of a block's tree in a group of n nodes: a block that isn't alone goes up to the full height."""
    return min(block, max(n - 1, 0).bit_length())


def root_of(leaves: list[bytes], height: int) -> bytes:
    for _ in range(height):
        leaves = [_hashed(leaves[k], leaves[k + 1] if k + 1 < len(leaves) else None) for k in range(0, len(leaves), 2)]
    return leaves[0]


def paths(leaves: list[bytes], height: int, subtree: int = SUBTREE) -> Iterator[list[tuple[str, bytes]]]:
    """Of each leaf in turn its siblings from below: ("L", those to the left), ("R", to the right), ("", where there is none)."""
    levels = [(low, min(low + subtree, height)) for low in range(0, height, subtree)]
    existing, desired = [], []
    for low, top in levels:
        first = Growing(leaves, 0, low, top)
        first.grow(first.left)
        existing.append(first.nodes)
        desired.append(Growing(leaves, 1 << top, low, top))
    for k in range(len(leaves)):
        path = []
        for (low, top), nodes in zip(levels, existing, strict=True):
            for height_now in range(low, top):
                at = k >> height_now
                other = nodes.get((height_now, at ^ 1))
                path.append(("L" if at & 1 else "R", other) if other else ("", b""))
        yield path
        for i, (low, top) in enumerate(levels):
            if not (k + 1) % (1 << top) and k + 1 < len(leaves):
                existing[i] = desired[i].nodes
                desired[i] = Growing(leaves, k + 1 + (1 << top), low, top)
            if desired[i].next < len(leaves) or desired[i].stack:
                desired[i].grow(2)


def folded(node: bytes, path: list[tuple[str, bytes]]) -> bytes:
    for side, other in path:
        node = sha256(other + node if side == "L" else node + other).hexdigest().encode()
    return node


def placed(leaves: DataFrame) -> DataFrame:
    """leaves (grp, id, leaf, other) with pos, each one's place in its group, from 0, and n, the group's size. The driver holds nothing; a task its part of the order."""
    spark = leaves.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["grp", "id", "leaf", "other"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, k = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            codes = coded.indices.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            run = np.arange(codes.size) - np.repeat(starts, np.diff(np.append(starts, codes.size)))
            if coded.dictionary[int(codes[0])].as_py() == last:
                run[: starts[1] if starts.size > 1 else codes.size] += k
            last, k = coded.dictionary[int(codes[-1])].as_py(), int(run[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(codes.size, part)), pa.array(run)], [*names, "part", "run"])

    # Equal rows are told apart by where they were read, so that ranges can divide them.
    order = ["grp", "id", "leaf", "tie"]
    told = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).select(*names)
    numbered = cut(told.mapInArrow(number, "grp string, id long, leaf string, other string, part long, run long"))
    before = F.sum("size").over(Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = numbered.groupBy("grp", "part").agg(F.count("*").alias("size"))
    offsets = cut(sizes.select("grp", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy("grp")).alias("n")))
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST else offsets
    return numbered.join(offsets, ["grp", "part"]).select(*names, (F.col("before") + F.col("run")).alias("pos"), "n")


BLOCKS = "grp string, block long, n long, ids array<long>, leaves binary, others array<string>, root string"


def blocks(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row (BLOCKS) for each aligned block of nodes (grp, id, leaf, other, pos, n)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # of the block that is open: (id, leaf, other) by place

        def closed() -> pa.RecordBatch:
            ids, leaves, others = zip(*held, strict=True)
            raw = [x.encode() for x in leaves]
            root = root_of(raw, height_of(key[2], block)).decode()
            columns = [[key[0]], [key[1]], [key[2]], [ids], [b"".join(raw)], [others], [root]]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for grp, at, n, i, node, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, at, n) != key:
                    if held:
                        yield closed()
                    key, held = (grp, at, n), []
                held.append((i, node, other))
        if held:
            yield closed()

    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = nodes.select("grp", F.shiftright("pos", block).alias("block"), "n", "id", "leaf", "other", "pos")
    return cut(told.repartition(parts, "grp", "block").sortWithinPartitions("grp", "block", "pos").drop("pos").mapInArrow(pack, BLOCKS))


def unpacked(row: dict) -> list[bytes]:
    return [row["leaves"][k : k + 64] for k in range(0, len(row["leaves"]), 64)]


def written(path: list[tuple[str, bytes]]) -> list[str]:
    return [side + other.decode() for side, other in path]


def read(steps: list[str]) -> list[tuple[str, bytes]]:
    return [(s[:1], s[1:].encode()) for s in steps]


def above(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (grp, pos, steps, top): of each node (grp, pos, n, leaf) the path up to the group's one node, and that."""
    if not nodes.where("n > 1").limit(1).count():
        return nodes.select("grp", "pos", F.array().cast("array<string>").alias("steps"), F.col("leaf").alias("top"))
    dealt = blocks(nodes.select("grp", F.col("pos").alias("id"), "leaf", F.lit(None).cast("string").alias("other"), "pos", "n"), block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = [written(p) + row["steps"] for p in paths(unpacked(row), height_of(row["n"], block))]
                k = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([row["grp"]] * k, pa.string()), pa.array(row["ids"], pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array([row["top"]] * k, pa.string())], ["grp", "pos", "steps", "top"])

    return cut(_under(dealt, block).mapInArrow(run, "grp string, pos long, steps array<string>, top string"))


def _under(dealt: DataFrame, block: int) -> DataFrame:
    """Blocks with the steps above them and the group's top."""
    roots = dealt.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(1 << block)).alias("n"), F.col("root").alias("leaf"))
    return dealt.join(above(roots, block).withColumnRenamed("pos", "block"), ["grp", "block"])


PROOFS = "grp string, id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, path array<string>"


def proofs(leaves: DataFrame, path: bool = True, block: int = BLOCK) -> DataFrame:
    """Rows (PROOFS) of leaves (grp, id, leaf, other): the roots of the group and of all; the proof, siblings from the leaf up to the root, as steps in
    `path` (L or R and the sibling, empty where there is none; null unless asked for) and as the hash of all siblings; and the root
    that follows from the proof and from `other`, a leaf to be tried in the leaf's place, or from the leaf itself where that is null.
    """
    grouped = leaves.withColumn("grp", F.when(F.col("grp").isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col("grp"))))  # null first
    dealt = _under(blocks(placed(grouped), block), block)
    dealt = cut(dealt)
    subroots = dealt.select("grp", "top").distinct().select(F.lit("").alias("grp"), F.lit(None).cast("long").alias("id"), F.col("top").alias("leaf"), F.col("grp").alias("other"))
    ranked = placed(subroots.select("grp", "id", F.col("other").alias("leaf"), F.col("leaf").alias("other")))
    ranked = cut(ranked.select("grp", F.col("leaf").alias("of"), F.col("other").alias("leaf"), "pos", "n"))
    tops = cut(above(ranked, block).join(ranked, "pos").select(F.col("of").alias("grp"), F.col("steps").alias("last"), F.col("top").alias("all")))
    tops = F.broadcast(tops) if tops.count() <= BROADCAST else tops

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                own, upper = unpacked(row), read(row["steps"] + row["last"])
                proof, trial, steps = [], [], []
                for node, other, low in zip(own, row["others"], paths(own, height_of(row["n"], block)), strict=True):
                    way = low + upper
                    proof.append(sha256(b"".join(s for _, s in way)).hexdigest())
                    trial.append(folded(other.encode() if other else node, way).decode())
                    steps.append(written(way) if path else None)
                same = [[x] * len(own) for x in (row["grp"][1:] if row["grp"] else None, row["top"], row["all"])]
                columns = [same[0], row["ids"], [x.decode() for x in own], same[1], same[2], proof, trial, steps]
                kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in PROOFS.split(", ")])

    return dealt.join(tops, "grp").mapInArrow(run, PROOFS)
