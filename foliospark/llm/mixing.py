"""Mixing sources to target weights by capped water-filling.

The level is found on the table of sources: clamp every source whose share exceeds `epochs` times its
size, divide the rest among the others by weight, and again until none is above. Each round is one
distributed aggregate that returns a row; the driver holds two numbers. A source then takes each
document floor(target / size) times, and once more the documents that come first in a seeded order
until the words still owed are reached; the document that crosses is taken if that comes nearer. The
seeded order is divided into hash ranges, 4096 or as many more as keep them small, whose sums are added up first, so that
only the range in which the boundary falls is sorted.

Defined results: null text has size 0 and is taken 0 times, a null source is a source of its own
(last in order), rows that are equal in id are ordered by size and text, no documents give no rows,
extra columns are ignored, or carried in a struct whatever they are called. Of rows alike in all but what is carried it is not
told which are taken more often.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, carried, cut, ranked

EPOCHS, SEED = 3, "mix-1"
#: Rows that a range of the seeded order has on average at most, where 4096 ranges don't suffice.
PER_RANGE = 20_000
CYCLE = (5, 2, 1)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, carry: list[str] = ()) -> DataFrame:
    """(carried, id, source, size, place, tie): words of the text and the place in the seeded order; carried: the columns of `carry` in a struct."""
    return docs.select(
        carried(list(carry)),
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("place"),
        F.xxhash64(F.col(text_col)).alias("tie"),
    )


def cycled_weights(sources: DataFrame) -> DataFrame:
    """(source, source_size, weight): weights 5, 2, 1 by code point of the source, null last. The table has a row for each source, not for each document."""
    weight = F.element_at(F.array(*map(F.lit, CYCLE)), (F.col("place") % len(CYCLE) + 1).cast("int")).cast("long")
    return ranked(sources, [F.col("source").asc_nulls_last()]).withColumn("weight", weight).drop("place")


def targets(weighted: DataFrame, epochs: int = EPOCHS, total: int | None = None) -> DataFrame:
    """weighted (source, source_size, weight) with `target`, in words."""
    whole = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    total = whole[0] if total is None else total
    level = (total or 0) / (whole[1] or 1)
    clamped = -1
    while True:
        full = F.col("source_size") * epochs <= F.lit(level) * F.col("weight")
        n, caps, rest = weighted.agg(F.count_if(full), F.sum(F.when(full, F.col("source_size") * epochs)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == clamped or not rest:
            break
        clamped, level = n, ((total or 0) - (caps or 0)) / rest
    return weighted.withColumn("target", F.least(F.col("source_size").cast("double") * epochs, F.lit(level) * F.col("weight")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", epochs: int = EPOCHS, seed: str = SEED, weigh=cycled_weights, carry: list[str] = ()) -> DataFrame:
    """Rows (carried, id, size, source, source_size, target, times, taken, tie), one for each row of docs. times: 0 to epochs; carried: the columns of `carry` in a struct."""
    items = cut(sized(docs, id_col, text_col, source_col, seed, carry))
    digits = max(3, math.ceil(math.log(max(1, items.count()) / PER_RANGE, 16)))
    bucket = F.substring("place", 1, digits)
    sums = cut(items.groupBy("source", bucket.alias("range")).agg(F.sum("size").alias("size")))
    plan = targets(cut(weigh(sums.groupBy("source").agg(F.sum("size").alias("source_size")))), epochs)
    plan = plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("owed", F.col("target") - F.col("whole") * F.col("source_size"))
    # The hash range in which the owed words run out: a source's ranges are added up, not its rows.
    over = Window.partitionBy("source").orderBy("range")
    run = sums.withColumn("upto", F.sum("size").over(over)).withColumn("before", F.col("upto") - F.col("size")).withColumnRenamed("source", "s").withColumnRenamed("size", "range_size")
    edge = run.join(plan, F.col("s").eqNullSafe(plan["source"])).where("before <= owed and owed < upto").select("s", F.col("range").alias("edge"), "before")
    plan = cut(plan.join(edge, plan["source"].eqNullSafe(edge["s"]), "left").select(F.col("source").alias("ps"), "source_size", "target", "whole", "owed", "edge", "before"))
    dealt = items.join(plan, items["source"].eqNullSafe(plan["ps"])).withColumn("range", bucket)
    at_edge = F.coalesce(F.col("range") == F.col("edge"), F.lit(False))
    order = Window.partitionBy("source", "range").orderBy("place", "id", "size", "tie")
    close = (
        dealt.where(at_edge)
        .withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("more", (F.col("upto") <= F.col("owed")) | ((F.col("upto") - F.col("size") < F.col("owed")) & (F.col("upto") - F.col("owed") < F.col("owed") - (F.col("upto") - F.col("size")))))
        .drop("upto")
    )
    clear = dealt.where(~at_edge).withColumn("more", (F.col("owed") > 0) & (F.col("edge").isNull() | (F.col("range") < F.col("edge"))))
    times = F.when(F.col("size") > 0, F.col("whole") + F.col("more").cast("long")).otherwise(F.lit(0).cast("long"))
    return clear.unionByName(close).withColumn("times", times).withColumn("taken", F.col("times") * F.col("size")).select("carried", "id", "size", "source", "source_size", "target", "times", "taken", "tie")
