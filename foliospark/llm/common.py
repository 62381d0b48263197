"""What the operators of this subpackage share: tables, the shared scratch folder and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these six.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where that is unset, and driver and executors are one process, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of an Arrow batch between Spark and Python, at most.
ARROW_BATCH = 8 << 20


def in_small_batches(spark: SparkSession) -> None:
    """Has this session hand rows to Python in batches of ARROW_BATCH bytes: each task holds a few of them on either side, whole texts among them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= ARROW_BATCH:
        spark.conf.set(key, str(ARROW_BATCH))


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(keep: list[str]) -> Column:
    """The columns of `keep` in one struct, so that their names meet no others; null without any."""
    return (F.struct(*[F.col(f"`{c}`").alias(c) for c in keep]) if keep else F.lit(None).cast("int")).alias("carried")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `place`, each row's place in the order, from 0: parts by range, whose sizes are added up. The driver holds a number for each part."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part)), pa.array(np.arange(k, k + batch.num_rows))], [*names, "__part", "__k"])
            k += batch.num_rows

    placed = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(count, rows.schema.add("__part", "long").add("__k", "long")))
    starts, so_far = [], 0
    for part, size in sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        starts.append((part, so_far))
        so_far += size
    offsets = rows.sparkSession.createDataFrame(starts, "__part long, __start long")
    return placed.join(F.broadcast(offsets), "__part").withColumn("place", F.col("__start") + F.col("__k")).select(*names, "place")


def words_of(text: Column) -> Column:
    """Words of a text, in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.array().cast("array<string>"))


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.binary()).to_pylist()


def pieces(batches: Iterator[pa.RecordBatch], size: int = 4_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts batches into slices of about `size` bytes of text, one row at least, so that memory follows texts and not row counts."""
    for batch in batches:
        sizes = np.fromiter((0 if x is None else x for x in _lengths(batch.column(batch.schema.get_field_index(column)))), np.int64, batch.num_rows)
        ends, start = np.cumsum(sizes), 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop
        del batch
        pa.default_memory_pool().release_unused()  # what batches of long texts took isn't kept for others


def _lengths(column: pa.Array) -> list[int | None]:
    import pyarrow.compute as pc

    return pc.binary_length(column).to_pylist()


class Memo(dict):
    """word -> value, computed at the first use and forgotten when `limit` words are held."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value
