import pytest

from foliospark.llm import mixing


def filled(sizes, weights, total):
    """Water-filling by hand."""
    share, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        w = sum(weights[k] for k in free)
        over = {k for k in free if left * weights[k] / w > 3 * sizes[k]}
        for k in over or free:
            share[k] = 3 * sizes[k] if over else left * weights[k] / w
        left -= sum(3 * sizes[k] for k in over)
        free = free - over if over else set()
    return share


def test_targets(spark):
    sizes, weights = [10, 1000, 5, 0, 400, 90], [5, 2, 1, 5, 2, 1]
    df = spark.createDataFrame([(str(k), s, w) for k, (s, w) in enumerate(zip(sizes, weights))], "source string, source_size long, weight long")
    got = {int(r.source): r.target for r in mixing.targets(df).collect()}
    want = filled(sizes, weights, sum(sizes))
    assert [got[k] for k in range(6)] == pytest.approx(want)
    assert sum(want) == pytest.approx(sum(sizes))


def test_odd_rows(spark):
    rows = [(1, None, "b", 0), (2, "a b c", None, 0), (2, "a b c", None, 0), (3, "", "a", 0), (None, "x " * 4000, "a", 0), (5, "y z q", "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mixing.mix(df).collect()
    assert len(out) == 6
    assert all(0 <= r.taken <= 3 * r.size and r.taken == r.times * r.size for r in out)
    assert sorted(r.size for r in out) == [0, 0, 2, 3, 3, 4000]
    assert mixing.mix(df.limit(0)).count() == 0


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = mixing.mix(docs).toPandas()
    assert len(out) == docs.count()
    by = out.groupby("source", dropna=False).agg(taken=("taken", "sum"), size=("size", "sum"), target=("target", "first"), most=("size", "max"))
    assert (abs(by.taken - by.target) <= by.most / 2 + 1).all()
    assert by.target.sum() == pytest.approx(by["size"].sum())
    again = mixing.mix(docs.repartition(7)).toPandas()
    key = ["id", "size", "taken"]
    assert out[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
