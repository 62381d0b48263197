"""Hard negatives by dual-tree search for largest inner products.

A tree is fitted to a bounded sample of vectors: each node splits along the line between two points far apart, at the
median. Every row is led through it to a leaf; a leaf's rows are packed in blocks, the leaves of the candidate tree.
Balls around the nodes' centres hold their rows. Anchors, rows of the same blocks, are packed in groups of neighbouring leaves.

Pairs of a group and a node go down the candidate tree level by level as joins of small tables: the balls give an
interval of the inner products that can occur between them, and a pair whose interval meets nothing that any of
the group's anchors can still use is dropped. What is left of a group and a slice of blocks meets in one task. There
both sides have trees of their own, whose node pairs are pruned in the same way, now by the best scores found so far; leaf
pairs are scored exactly. The best of each slice are merged by a window. The search runs twice: for positives, the best rows of
an anchor's label, with what an anchor finds in its own block as first bounds; and for negatives, best rows of other labels in a
range of scores for each positive, all ranges of an anchor in one pass.

Vectors without clusters leave wide intervals: then no pair is pruned and the search is that of a set of anchors against all rows, in blocks.

Defined results: a null label or vector, or a null or non-finite component (also once scaled) takes no part. Rows are told apart by
where they are packed: repeated rows are others of each other, and each repeated anchor has its rows. A null id is no anchor and comes last among equal scores.
Shorter vectors have zeros at the end. Scores are exact integers; beyond 64 bits they count as the largest or smallest long. Anchors without
positives, and positives without a negative in range, have no rows. No rows give none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a block, most leaves of the fitted tree, rows that it is fitted to, levels that the frontier goes down at once.
SIZE, LEAVES, SAMPLE, STEP = 2048, 4096, 16384, 4
#: Anchors of a group, and of a leaf of its tree; rows of a leaf of a block's tree; blocks of a slice.
GROUP, FEW, PART, SLICE = 16384, 128, 512, 32
_LOW, _HIGH = -(2**63) + 1, 2**63 - 1
_NONE = -(2**63)


def split(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction between two points far apart, and the median along it."""
    a = x[np.argmax(((x - x.mean(0)) ** 2).sum(1))]
    b = x[np.argmax(((x - a) ** 2).sum(1))]
    return b - a, float(np.median(x @ (b - a)))


class Tree:
    """A complete binary tree of splits: direction, threshold and centre of each node, the children of k at 2k + 1 and 2k + 2."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.dim = depth, sample.shape[1]
        n = (2 << depth) - 1
        self.direction, self.threshold, self.centre = np.zeros((n, self.dim)), np.zeros(n), np.zeros((n, self.dim))
        rows = {0: sample}
        for k in range(n):
            x = rows.pop(k)
            self.centre[k] = x.mean(0) if len(x) else self.centre[(k - 1) // 2]
            if k < n // 2:
                if len(x) > 1:
                    self.direction[k], self.threshold[k] = split(x)
                side = x @ self.direction[k] > self.threshold[k]
                rows[2 * k + 1], rows[2 * k + 2] = x[~side], x[side]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf, from 0, of each row."""
        at, x = np.zeros(len(x), np.int64), widened(x, self.dim)[:, : self.dim]
        for _ in range(self.depth):
            at = 2 * at + 1 + (np.einsum("ij,ij->i", x, self.direction[at]) > self.threshold[at])
        return at - ((1 << self.depth) - 1)

    def centres(self, leaf: int) -> list[np.ndarray]:
        """Centres on the way from the root to the leaf."""
        return [self.centre[(1 << d) - 1 + (leaf >> (self.depth - d))] for d in range(self.depth + 1)]


def widened(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] >= dim else np.hstack([x, np.zeros((len(x), dim - x.shape[1]))])


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, zeros behind short ones."""
    ends = np.asarray(column.offsets).astype(np.int64)
    flat, sizes = column.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    if sizes.size and (sizes == sizes[0]).all():
        return flat.reshape(sizes.size, sizes[0]).astype(np.float64)
    out = np.zeros((sizes.size, int(sizes.max(initial=0))))
    for k, (start, n) in enumerate(zip(ends[:-1] - ends[0], sizes, strict=True)):
        out[k, :n] = flat[start : start + n]
    return out


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(n, -1)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers, as longs."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if not dim:
        return np.zeros((len(a), len(b)), np.int64)
    if np.sqrt((a * a).sum(1).max(initial=0)) * np.sqrt((b * b).sum(1).max(initial=0)) < 2.0**52:
        return (a @ b.T).astype(np.int64)
    big = [[int(x) for x in row] for row in a.tolist()], [[int(x) for x in row] for row in b.tolist()]
    return np.array([[min(max(sum(p * q for p, q in zip(x, y, strict=True)), _LOW), _HIGH) for y in big[1]] for x in big[0]], np.int64).reshape(len(a), len(b))


class Node:
    """A node of a task's own tree: rows by number, their ball, and two children or none."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, few: int):
        own = x[rows]
        self.rows, self.centre = rows, own.mean(0)
        self.norm, self.radius = float(np.sqrt((self.centre**2).sum())), float(np.sqrt(((own - self.centre) ** 2).sum(1).max()))
        self.children = []
        if rows.size > few:
            direction, threshold = split(own)
            side = own @ direction > threshold
            if side.any() and not side.all():
                self.children = [Node(x, rows[~side], few), Node(x, rows[side], few)]
            else:
                self.children = [Node(x, part, few) for part in np.array_split(rows, 2)]


def interval(a: Node, b: Node) -> tuple[float, float]:
    """Between which values inner products of rows of two balls lie."""
    dim = min(a.centre.size, b.centre.size)
    middle, most = float(a.centre[:dim] @ b.centre[:dim]), a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    slack = 1e-9 * (a.norm + a.radius) * (b.norm + b.radius)
    return middle - most - slack, middle + most + slack


class Search:
    """The best rows of each range of each anchor of a group, over blocks that come one by one."""

    def __init__(self, row: dict, same: bool, best: int):
        self.n, self.same, self.best = row["n"], same, best
        self.x, self.labels = unpacked(row["matrix"], self.n), np.array(row["labels"], np.int64)
        self.block, self.at = np.array(row["home"], np.int64), np.array(row["at"], np.int64)
        self.low, self.high = (np.frombuffer(row[c], np.int64).reshape(self.n, -1).copy() for c in ("low", "high"))
        shape = (*self.low.shape, best)
        self.score, self.id, self.null = np.full(shape, _NONE), np.zeros(shape, np.int64), np.zeros(shape, bool)
        self.root = Node(self.x, np.arange(self.n), FEW)
        self.pairs = self.scored = 0

    def meet(self, row: dict) -> None:
        x, labels = unpacked(row["matrix"], row["n"]), np.array(row["labels"], np.int64)
        null = np.array([i is None for i in row["ids"]])
        ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        tree = Node(x, np.arange(row["n"]), PART)
        todo = [(*interval(self.root, tree), self.root, tree)]
        while todo:
            low, high, a, b = todo.pop()
            self.pairs += 1
            if high < float(self.low[a.rows].min()) or low > float(self.high[a.rows].max()):
                continue
            if a.children and (not b.children or a.rows.size * PART >= b.rows.size * FEW):
                below = [(c, b) for c in a.children]
            elif b.children:
                below = [(a, c) for c in b.children]
            else:
                self.scored += 1
                self.score_leaves(a.rows, np.sort(b.rows), x, labels, ids, null, row["block"])
                continue
            # What can reach the highest scores comes first, so that bounds rise early.
            todo += sorted([(*interval(*pair), *pair) for pair in below], key=lambda t: t[1])

    def score_leaves(self, rows: np.ndarray, cols: np.ndarray, x: np.ndarray, labels: np.ndarray, ids: np.ndarray, null: np.ndarray, block: int) -> None:
        s = scores(self.x[rows], x[cols])
        fits = (self.labels[rows][:, None] == labels[cols]) == self.same
        if self.same:
            fits &= (self.block[rows] != block)[:, None] | (self.at[rows][:, None] != cols)
        for r in range(self.low.shape[1]):
            ok = fits & (s >= self.low[rows, r, None]) & (s <= self.high[rows, r, None])
            hit = np.flatnonzero(ok.any(1))
            if hit.size:
                # Columns are in order of id, so that the first of equal scores are those of the smallest ids.
                found = np.where(ok[hit], s[hit], _NONE)
                top = best_of(found, self.best)
                self.add(rows[hit], r, np.take_along_axis(found, top, 1), ids[cols][top], null[cols][top])

    def add(self, rows: np.ndarray, r: int, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, i, z = (np.hstack([old[rows, r], new]) for old, new in ((self.score, score), (self.id, ids), (self.null, null)))
        order = np.lexsort((i, z, np.where(s == _NONE, _HIGH, -np.maximum(s, _LOW)), s == _NONE), axis=1)[:, : self.best]
        self.score[rows, r], self.id[rows, r], self.null[rows, r] = (np.take_along_axis(y, order, 1) for y in (s, i, z))
        self.low[rows, r] = np.maximum(self.low[rows, r], self.score[rows, r, -1])

    def result(self) -> pa.RecordBatch:
        k, r, j = np.nonzero(self.score != _NONE)
        columns = [pa.array(self.block[k]), pa.array(self.at[k]), pa.array(r.astype(np.int32)), pa.array(self.score[k, r, j]), pa.array(self.id[k, r, j], mask=self.null[k, r, j])]
        return pa.RecordBatch.from_arrays(columns, ["home", "at", "r", "score", "id"])


def best_of(found: np.ndarray, best: int) -> np.ndarray:
    """Columns of the `best` largest values of each row, the first of equal ones."""
    if found.shape[1] > 4 * best:
        low, high = found[found != _NONE].min(initial=0), found.max()
        if max(-int(low), int(high)) < 2**50 // found.shape[1]:
            n = found.shape[1]
            key = np.where(found == _NONE, np.iinfo(np.int64).min + n, found * n) - np.arange(n)
            return np.argpartition(-key, best - 1, axis=1)[:, :best]
    return np.argsort(np.where(found == _NONE, _HIGH, -np.maximum(found, _LOW)), axis=1, kind="stable")[:, :best]


def fit(rows: DataFrame) -> Tree:
    """A tree over a sample of SAMPLE rows or up to twice as many; what is found doesn't depend on it."""
    n = rows.count()
    depth = min(LEAVES.bit_length() - 1, max(0, -(-n // SIZE) - 1).bit_length())
    picked = rows.where(F.pmod(F.xxhash64("v"), F.lit(max(1, n // SAMPLE))) == 0).select("v").limit(2 * SAMPLE)
    sample = [r.v for r in picked.collect()] if depth else []
    dim = max(map(len, sample), default=0)
    return Tree(np.array([list(v) + [0.0] * (dim - len(v)) for v in sample]).reshape(len(sample), dim), depth)


BLOCK = "block long, leaf int, n int, ids array<long>, labels array<long>, matrix binary, radii array<double>"


def blocks(rows: DataFrame, tree: Tree) -> DataFrame:
    """rows (id, label, v) packed in blocks (BLOCK) of SIZE at most; radii: of the balls around the centres from the root to the leaf that hold the block."""
    spark = rows.sparkSession
    parts, held, size = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.broadcast(tree), SIZE

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = held.value.leaf(matrix(batch.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(leaves.astype(np.int32)), *batch.columns], ["leaf", "id", "label", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, k, open_ = None, 0, []

        def closed() -> pa.RecordBatch:
            ids, labels, v = zip(*open_, strict=True)
            x = matrix(pa.array(v, pa.list_(pa.float64())))
            radii = []
            for c in held.value.centres(key[0]):
                dim = max(c.size, x.shape[1])
                radii.append(float(np.sqrt(((widened(x, dim) - np.pad(c, (0, dim - c.size))) ** 2).sum(1).max())))
            columns = [[(key[0] << 40) + (key[1] << 20) + k], [key[0]], [len(ids)], [ids], [labels], [x.tobytes()], [radii]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

        for batch in batches:
            for leaf, salt, i, label, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (leaf, salt) != key or len(open_) == size:
                    if open_:
                        yield closed()
                    k = k + 1 if (leaf, salt) == key else 0
                    key, open_ = (leaf, salt), []
                open_.append((i, label, v))
        if open_:
            yield closed()

    routed = cut(rows.select("id", "label", "v").mapInArrow(route, "leaf int, id long, label long, v array<double>"))
    # A leaf of many rows is dealt out to several tasks: a number for each of at most LEAVES leaves.
    salts = routed.groupBy("leaf").agg(F.ceil(F.count("*") / (16 * size)).alias("salts"))
    salted = routed.join(F.broadcast(salts), "leaf").select("leaf", F.pmod(F.monotonically_increasing_id(), F.col("salts")).alias("salt"), "id", "label", "v")
    dealt = salted.repartition(parts, "leaf", "salt").sortWithinPartitions("leaf", "salt", F.col("id").asc_nulls_last(), "label", "v")
    return cut(dealt.mapInArrow(pack, BLOCK))


ANCHOR = "home long, at long, leaf int, id long, label long, v binary, low array<long>, high array<long>"


def anchors(packed: DataFrame, every: int, positives: int) -> DataFrame:
    """Rows (ANCHOR) of ids divisible by `every`. low: the last of the best scores of the same label in the anchor's own block, if there are enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = [k for k, i in enumerate(row["ids"]) if i is not None and i % every == 0]
                if not at:
                    continue
                x, labels = unpacked(row["matrix"], row["n"]), np.array(row["labels"], np.int64)
                s = np.where(labels[at][:, None] == labels, scores(x[at], x), _NONE)
                s[np.arange(len(at)), at] = _NONE
                s = np.hstack([s, np.full((len(at), positives), _NONE)])
                low = np.maximum(np.sort(s, 1)[:, -positives], _LOW)
                columns = [[row["block"]] * len(at), at, [row["leaf"]] * len(at), [row["ids"][k] for k in at], labels[at], [x[k].tobytes() for k in at], [[v] for v in low.tolist()], [[_HIGH]] * len(at)]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in ANCHOR.split(", ")])

    return cut(packed.mapInArrow(run, ANCHOR))


GROUPED = "grp long, n int, home array<long>, at array<long>, labels array<long>, matrix binary, low binary, high binary, centre array<double>, norm double, radius double, least double, most double"


def groups(found: DataFrame) -> DataFrame:
    """Anchors (ANCHOR) packed by neighbouring leaves (GROUPED), GROUP in a row or a few more. least, most: between which scores any of them can use a row."""
    sizes, mapped, upto = sorted((r.leaf, r.n) for r in found.groupBy("leaf").agg(F.count("*").alias("n")).collect()), [], 0
    first = 0  # of at most LEAVES leaves
    for leaf, n in sizes:
        if upto and upto + n > GROUP:
            first, upto = first + 1, 0
        mapped.append((leaf, first, -(-n // GROUP)))
        first, upto = (first + mapped[-1][2], 0) if n > GROUP else (first, upto + n)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, open_ = None, []

        def closed() -> pa.RecordBatch:
            home, at, labels, v, low, high = zip(*open_, strict=True)
            rows = [np.frombuffer(x, np.float64) for x in v]
            dim, ranges = max(x.size for x in rows), max(map(len, low))
            x = np.array([np.pad(y, (0, dim - y.size)) for y in rows])
            # A range that an anchor doesn't have holds no score.
            low, high = (np.array([[*y, *[empty] * (ranges - len(y))] for y in z], np.int64).reshape(len(z), ranges) for z, empty in ((low, _HIGH), (high, _LOW)))
            node = Node(x, np.arange(len(x)), len(x))
            columns = [[key], [len(x)], [home], [at], [labels], [x.tobytes()], [low.tobytes()], [high.tobytes()], [node.centre.tolist()], [node.norm], [node.radius], [float(low.min(initial=_HIGH))], [float(high.max(initial=_LOW))]]
            kinds = [pa.int64(), pa.int32(), *[pa.list_(pa.int64())] * 3, *[pa.binary()] * 3, pa.list_(pa.float64()), *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in GROUPED.split(", ")])

        for batch in batches:
            for grp, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if grp != key:
                    if open_:
                        yield closed()
                    key, open_ = grp, []
                open_.append(row)
        if open_:
            yield closed()

    spark = found.sparkSession
    where = F.broadcast(spark.createDataFrame(mapped, "leaf int, first long, many long"))
    told = found.join(where, "leaf").select((F.col("first") + F.pmod(F.xxhash64("home", "at"), F.col("many"))).alias("grp"), "home", "at", "label", "v", "low", "high", "leaf")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut(told.repartition(parts, "grp").sortWithinPartitions("grp", "leaf", "home", "at").drop("leaf").mapInArrow(pack, GROUPED))


def meeting(grouped: DataFrame, packed: DataFrame, tree: Tree) -> DataFrame:
    """Pairs (grp, block) that can have scores of use: the frontier goes down the candidate tree, a few levels at a time."""
    spark = grouped.sparkSession
    norms = np.sqrt((tree.centre**2).sum(1))
    centres = spark.createDataFrame([(d, k - (1 << d) + 1, tree.centre[k].tolist(), float(norms[k])) for d in range(tree.depth + 1) for k in range((1 << d) - 1, (2 << d) - 1)], "depth int, node int, c array<double>, cn double")
    balls = packed.select("leaf", F.posexplode("radii").alias("depth", "radius")).select("depth", F.expr(f"shiftright(leaf, {tree.depth} - depth)").alias("node"), "radius")
    nodes = cut(balls.groupBy("depth", "node").agg(F.max("radius").alias("cr")).join(F.broadcast(centres), ["depth", "node"]))  # at most twice LEAVES rows
    middle = F.aggregate(F.zip_with("centre", "c", lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    most = (F.col("norm") * F.col("cr") + F.col("cn") * F.col("radius") + F.col("radius") * F.col("cr")) * 1.000001 + 1e-6 * (F.col("norm") * F.col("cn") + 1)

    def useful(pairs: DataFrame) -> DataFrame:
        return pairs.where((middle + most >= F.col("least")) & (middle - most <= F.col("most")))

    now, before = grouped.select("grp", "centre", "norm", "radius", "least", "most", F.shiftright("grp", 63).cast("int").alias("at")), 0  # the root is node 0
    kept = ["grp", "centre", "norm", "radius", "least", "most"]
    for depth in sorted({*range(0, tree.depth, STEP), tree.depth}):
        children = nodes.where(F.col("depth") == depth).select(F.col("node").alias("to"), F.expr(f"shiftright(node, {depth - before})").alias("at"), "c", "cn", "cr")
        now, before = useful(now.select(*kept, "at").join(F.broadcast(children), "at")).select(*kept, F.col("to").alias("at"), "c", "cn"), depth
    own = packed.select("block", F.col("leaf").alias("at"), F.element_at("radii", -1).alias("cr"))
    return cut(useful(now.join(own, "at")).select("grp", "block"))


MEETING = "grp long, slice int, kind int, block long, n int, ids array<long>, labels array<long>, matrix binary, home array<long>, at array<long>, low binary, high binary"


def search(grouped: DataFrame, packed: DataFrame, tree: Tree, same: bool, best: int) -> DataFrame:
    """Rows (home, at, r, score, id, rank): the `best` rows of each anchor's ranges, of its label (same) or of others."""
    spark = grouped.sparkSession
    pairs = meeting(grouped, packed, tree)
    slices = -(-packed.count() // SLICE)
    placed = pairs.withColumn("slice", F.pmod(F.xxhash64("block"), F.lit(max(1, slices))).cast("int"))
    names = [x.split()[0] for x in MEETING.split(", ")]
    kinds = {x.split()[0]: x.split()[1] for x in MEETING.split(", ")}
    full = lambda df: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in names])
    left = placed.select("grp", "slice").distinct().join(grouped.select("grp", "n", "home", "at", "labels", "matrix", "low", "high"), "grp").withColumn("kind", F.lit(0))
    right = placed.join(packed.select("block", "n", "ids", "labels", "matrix"), "block").withColumn("kind", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["kind"] == 0:
                    if now:
                        yield now.result()
                    now = Search(row, same, best)
                else:
                    now.meet(row)
        if now:
            yield now.result()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = full(left).unionByName(full(right)).repartition(parts, "grp", "slice").sortWithinPartitions("grp", "slice", "kind", "block")
    found = met.mapInArrow(run, "home long, at long, r int, score long, id long")
    order = Window.partitionBy("home", "at", "r").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for rows (id, label, vector).

    A component x counts as floor(scale * x). Negatives have between `low` and `high` hundredths of the positive's score.
    """
    v = F.transform(F.col("vector").cast("array<double>"), lambda x: x * scale)
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    told = rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), v.alias("v")).where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(whole)

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = np.floor(lists.values.to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(lists.offsets, pa.array(values))], ["id", "label", "v"])

    told = cut(told.mapInArrow(floors, "id long, label long, v array<double>"))
    tree = fit(told)
    packed = blocks(told, tree)
    first = anchors(packed, every, positives)
    best = cut(search(groups(first), packed, tree, True, positives).select("home", "at", F.col("rank").alias("r"), F.col("score").alias("p"), F.col("id").alias("positive_id")))
    # 30 p <= 100 s <= 90 p, in whole numbers; a range without any is left empty.
    span = best.select("home", "at", "r", F.ceil(F.col("p").cast("decimal(38,0)") * low / 100).cast("long").alias("low"), F.floor(F.col("p").cast("decimal(38,0)") * high / 100).cast("long").alias("high"))
    spans = span.groupBy("home", "at").agg(F.sort_array(F.collect_list(F.struct("r", "low", "high"))).alias("s"))
    second = cut(first.drop("low", "high").join(spans, ["home", "at"]).withColumns({"low": F.col("s.low"), "high": F.col("s.high")}).select(*[x.split()[0] for x in ANCHOR.split(", ")]))
    worst = search(groups(second), packed, tree, False, negatives).select("home", "at", (F.col("r") + 1).alias("r"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = best.join(first.select("home", "at", F.col("id").alias("anchor_id")), ["home", "at"])
    return worst.join(named, ["home", "at", "r"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", F.col("p").alias("positive_score"), "negative_score")
