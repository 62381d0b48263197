"""Sources and sinks: files by kind, sample files, page geometry, JSON rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.numbers import let, stripped

# Extensions that are taken.
EXTENSIONS = ["png", "jpg", "jpeg", "pdf", "doc", "docx"]
REGIONS = {"header": (0.0, 0.0, 1.0, 0.33), "page_header": (0.0, 0.0, 1.0, 0.35), "right": (0.5, 0.0, 1.0, 0.27), "bill_of_lading": (0.0, 0.0, 1.0, 0.45)}


def file_kind(path: Column) -> Column:
    """pdf, word, image or unsupported."""
    low = F.lower(path)
    return F.when(low.rlike(r"\.pdf$"), "pdf").when(low.rlike(r"\.docx?$"), "word").when(low.rlike(r"\.(?:png|jpe?g)$"), "image").otherwise("unsupported")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, kind, error) of a folder's files; contents are not read. Unsupported files are rows with an error."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return found.withColumn("kind", file_kind(F.col("path"))).withColumn("error", F.when(F.col("kind") == "unsupported", "Unsupported file format"))


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a local one only where that is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(found or tempfile.mkdtemp(prefix='folio-')).rstrip('/')}/read-{uuid.uuid4().hex}"


#: What ends the rule above a banner, and begins the banner; no more of the rule, as a break that overlaps itself is lost where it lies across two splits.
_BREAK = "={end}=== SAMPLE "


def samples(spark: SparkSession, path: str, end: str = "\n") -> DataFrame:
    """(path, sample_no, name, text, error) of files whose samples stand below a banner `=== SAMPLE n - name ===` between rules; wrapping quotes go.

    Records are cut at the banners while they are read, so that one file of many samples is read by several tasks. Text above a file's first banner, or below one
    that is no banner after all, is a row with an error. end: what ends the files' lines.
    """
    read = spark.read.option("lineSep", _BREAK.format(end=end)).text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"=+\s*$", "").alias("value"))
    banner = r"^(\d+) - ([^\n=]*?) =+\s*\n={20,}"
    one = read.where(stripped(F.col("value")) != "").withColumn("good", F.col("value").rlike(banner))
    part = lambda k: F.when(F.col("good"), F.regexp_extract("value", banner, k))
    body = F.when(F.col("good"), F.regexp_replace("value", banner, "")).otherwise(F.col("value"))
    return one.select("path", part(1).cast("int").alias("sample_no"), part(2).alias("name"), unquoted(body).alias("text"), F.when(~F.col("good"), "No banner above the text").alias("error"))


def unquoted(text: Column) -> Column:
    return F.regexp_replace(stripped(text), '(?s)^"(.*)",?$', "$1")


def drawn(rows: DataFrame, name: str = "TÊN FILE", forms: tuple[str, ...] = ("DRAW_MARKDOWN", "DRAW_PLAIN")) -> DataFrame:
    """(file_name, form, raw_text) of a corpus that holds recognised texts in a column for each form: a row for each text that is there. Columns that are missing give none."""
    there = {c.lower(): c for c in rows.columns}
    held = [F.struct(F.lit(f.lower().removeprefix("draw_")).alias("form"), F.col(f"`{there[f.lower()]}`").cast("string").alias("raw_text")) for f in forms if f.lower() in there]
    file = F.col(f"`{there[name.lower()]}`") if name.lower() in there else F.lit(None)
    texts = F.array(*held) if held else F.array().cast("array<struct<form:string,raw_text:string>>")
    return rows.select(file.cast("string").alias("file_name"), F.inline(texts)).where("raw_text IS NOT NULL")


def split_samples(df: DataFrame, text_col: str = "value", keep: list[str] = ()) -> DataFrame:
    banner = r"={20,}\s*\n=+ SAMPLE (\d+) - ([^\n=]*?) =+\s*\n={20,}"
    pieces = let(F.split(text_col, banner.replace("(", "(?:")), lambda x: F.slice(x, F.lit(2), F.size(x)))
    numbers, names = (F.regexp_extract_all(text_col, F.lit(banner), F.lit(k)) for k in (1, 2))
    both = df.select(*keep, F.explode(F.arrays_zip(numbers.alias("n"), names.alias("name"), pieces.alias("text"))).alias("s"))
    return both.select(*keep, F.col("s.n").cast("int").alias("sample_no"), F.col("s.name").alias("name"), unquoted(F.col("s.text")).alias("text"))


def raster_zoom(width: Column, height: Column, dpi: int = 300, longest: int = 4096) -> Column:
    """The zoom at which a page is drawn: by resolution, less where a side would pass the limit, 0.5 at least."""
    zoom = F.lit(dpi / 72.0)
    side = F.greatest(width, height)
    return F.greatest(F.when(side * zoom > longest, F.lit(float(longest)) / side).otherwise(zoom), F.lit(0.5))


def region(name: str, width: Column, height: Column) -> Column:
    """(x0, y0, x1, y1) of a named region of a page."""
    return F.struct(*[(F.lit(v) * (width if k % 2 == 0 else height)).alias(n) for k, (n, v) in enumerate(zip(("x0", "y0", "x1", "y1"), REGIONS[name], strict=True))])


def json_rows(invoices: DataFrame, path: str) -> None:
    """A JSON line for each invoice, items nested; dates are written as dd/MM/yyyy."""
    dates = {c: F.date_format(c, "dd/MM/yyyy") for c, t in invoices.dtypes if t == "date"}
    invoices.withColumns(dates).write.mode("errorifexists").json(path)


def flat_rows(invoices: DataFrame) -> DataFrame:
    """invoices with the items as a JSON string, for row formats."""
    return invoices.withColumn("items", F.to_json("items"))
