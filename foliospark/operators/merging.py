"""Evidence of several passes over a document: when to look again, and which value stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.numbers import stripped
from foliospark.functions.words import vn_spoken_to_number

FILL_ONLY = ["sellerPhoneNumber", "sellerEmail", "invoiceSerial", "paymentMethod", "currency", "buyerPhoneNumber", "buyerEmail"]
OVERRIDE = ["buyerName", "invoiceFormNo"]
# Words of a valid title, and titles of copies.
TITLE_WORDS = "hóa đơn|hoá đơn|phiếu|invoice|bill|receipt"
COPY_TITLES = "bản sao|copy"


def _missing(c: Column) -> Column:
    return F.coalesce(stripped(c), F.lit("")) == ""


def missing_fields(single_page: bool = True) -> Column:
    """The fields whose lack or look calls for a second pass over the head of the page."""
    title, form = F.lower(F.col("invoiceName")), F.lower(F.col("invoiceFormNo"))
    bad = {
        "invoiceID": _missing(F.col("invoiceID")) | (single_page & (F.length("invoiceID") < 3) if single_page else F.lit(False)),
        "invoiceSerial": _missing(F.col("invoiceSerial")),
        "invoiceFormNo": _missing(F.col("invoiceFormNo")) | (form.rlike("điều|mẫu") if single_page else F.lit(False)),
        "sellerName": _missing(F.col("sellerName")),
        "buyerName": _missing(F.col("buyerName")),
    }
    if single_page:
        bad |= {"invoiceDate": _missing(F.col("invoiceDate")), "invoiceName": _missing(F.col("invoiceName")) | ~title.rlike(TITLE_WORDS) | title.startswith("(") | title.rlike(COPY_TITLES)}
    return F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(True)), k) for k, v in bad.items()]))


def longer_address(raw: Column, zoom: Column) -> Column:
    """The longer of two addresses; the first stays if it names a street or if the second has fewer digits."""
    digits = lambda x: F.length(F.regexp_replace(x, r"\D", ""))
    street = raw.rlike(r"(?iu)\b(?:street|st\.|road|đường|phố)(?:\b|\s|$)")
    longer = (F.length(zoom) > F.length(raw)) & ~street & (digits(zoom) >= digits(raw))
    return F.when(_missing(raw), zoom).when(F.coalesce(longer, F.lit(False)), zoom).otherwise(raw)


def merge(raw: DataFrame, zoom: DataFrame, key: str) -> DataFrame:
    """raw with what zoom adds: of FILL_ONLY where raw has none, of OVERRIDE wherever zoom has one, addresses by length, others where raw has none."""
    fields = [c for c in raw.columns if c != key]
    both = raw.join(zoom.select(key, *[F.col(c).alias(f"z_{c}") for c in zoom.columns if c != key]), key, "left")

    def chosen(c: str) -> Column:
        if f"z_{c}" not in both.columns:
            return F.col(c)
        own, other = F.when(~_missing(F.col(c)), F.col(c)), F.when(~_missing(F.col(f"z_{c}")), F.col(f"z_{c}"))
        return F.coalesce(other, own) if c in OVERRIDE else longer_address(own, other) if c.endswith("Address") else F.coalesce(own, other)

    merged = both.select(key, *[chosen(c).alias(c) for c in fields])
    if "currency" in fields and "invoiceName" in fields:
        merged = merged.withColumn("currency", F.coalesce("currency", F.when(F.lower("invoiceName").rlike("hóa đơn|phiếu"), "VND")))
    return merged


def refined(df: DataFrame, answer: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """df with the fields of a model's answer where df has none; rows that lack more than half of the fields stay as they are."""
    lacks = sum(_missing(F.col(f).cast("string")).cast("int") for f in fields)
    both = df.withColumn("__lacks", lacks).join(answer.select(F.col(key).alias("__key"), *[F.col(f).alias(f"__{f}") for f in fields]), F.col(key) == F.col("__key"), "left")
    take = F.col("__lacks") <= len(fields) * 0.5
    return both.select(*[F.when(take & _missing(F.col(c).cast("string")), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in df.columns])


def total_from_words(total: Column, words: Column) -> Column:
    """The total, or what the words say where it is missing or zero."""
    said = vn_spoken_to_number(words)
    return F.when(F.coalesce(total, F.lit(0.0)) != 0, total).otherwise(F.when(said > 0, said))
