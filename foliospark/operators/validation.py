"""Checks of extracted invoices: arithmetic, dates, tax codes, provenance and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.numbers import found
from foliospark.operators.items import amount_sum

CRITICAL = ["invoiceID", "sellerName", "buyerName", "sellerTaxCode", "buyerTaxCode"]
#: The fields that flags ask for.
CHECKED = [*CRITICAL, "invoiceDate", "totalAmount", "preTaxPrice", "taxAmount"]


def item_math_flags(items: Column) -> Column:
    """Places of items whose quantity times price is off the amount by more than 0.5."""
    bad = lambda x: (x["quantity"] > 0) & (x["unitPrice"] > 0) & (x["amount"] > 0) & (F.abs(F.bround(x["quantity"] * x["unitPrice"], 2) - x["amount"]) > 0.5)
    return F.array_compact(F.transform(items, lambda x, k: F.when(bad(x), F.concat(F.lit("item_"), k.cast("string"), F.lit("_math")))))


def total_differs(total: Column, pre_tax: Column, items_sum: Column) -> Column:
    """Whether the items' sum is off the total, and off the pre-tax sum where there is one, by more than 2 %."""
    off = lambda x: F.abs(x - items_sum) / F.greatest(x, items_sum) > 0.02
    checked = (F.coalesce(total, F.lit(0.0)) != 0) & (items_sum > 0)
    return F.coalesce(checked & off(total) & F.when(F.coalesce(pre_tax, F.lit(0.0)) > 0, off(pre_tax)).otherwise(True), F.lit(False))


def tax_sum_differs(total: Column, pre_tax: Column, tax: Column) -> Column:
    """Whether pre-tax and tax miss the total by more than 1."""
    return F.coalesce((total != 0) & (F.abs(F.bround(pre_tax + F.coalesce(tax, F.lit(0.0)), 2) - total) > 1.0), F.lit(False))


def date_out_of_range(text: Column) -> Column:
    """Whether an ISO date's parts are out of range; the calendar is not asked."""
    part = lambda k: found(text, r"^(\d{4})-(\d{1,2})-(\d{1,2})", k).try_cast("int")
    return F.coalesce(~(part(1).between(1900, 2100) & part(2).between(1, 12) & part(3).between(1, 31)), F.lit(False))


def tax_code_short(code: Column) -> Column:
    return F.coalesce((code != "") & (F.length(F.translate(code, " -", "")) < 5), F.lit(False))


def not_in_source(value: Column, text: Column, is_code: bool = False) -> Column:
    """Whether a value can't be found in the text, whatever the case; codes may be spaced there."""
    there = F.contains(F.lower(text), F.lower(value))
    if is_code:
        there = there | F.contains(F.translate(text, " ", ""), F.translate(value, " -", ""))
    return F.coalesce((value != "") & ~there, F.lit(False))


def confidence(value: Column, text: Column) -> Column:
    """HIGH: verbatim, or as an integer with points; MEDIUM: half of the longer words or none to look for; else LOW; null without a value."""
    number = value.try_cast("double")
    whole = F.when(number == F.floor(number), F.format_number(number, 0))
    as_number = F.contains(text, F.translate(whole, ",", ".")) | F.contains(text, F.translate(whole, ",", ""))
    words = F.filter(F.split(value, r"\s+"), lambda w: F.length(w) > 2)
    share = F.size(F.filter(words, lambda w: F.contains(text, w))) / F.size(words)
    rest = F.when(F.length(value) <= 3, "LOW").when(F.size(words) == 0, "MEDIUM").when(share >= 0.5, "MEDIUM").otherwise("LOW")
    return F.when(value.isNotNull(), F.when(F.contains(text, value) | F.coalesce(as_number, F.lit(False)), "HIGH").otherwise(rest))


def validate(invoices: DataFrame, text: Column) -> DataFrame:
    """invoices (columns named as fields, `items`) with `flags` and `confidence` (map field -> level); `text` is what they came from."""
    col = lambda c: F.col(c) if c in invoices.columns else F.lit(None).cast("string")
    num = lambda c: F.col(c) if c in invoices.columns else F.lit(None).cast("double")
    single = {
        "total_vs_items": total_differs(num("totalAmount"), num("preTaxPrice"), amount_sum(F.col("items"))),
        "pretax_plus_tax": tax_sum_differs(num("totalAmount"), num("preTaxPrice"), num("taxAmount")),
        "invalid_date": date_out_of_range(col("invoiceDate")),
        **{f"{c}_short": tax_code_short(col(c)) for c in ("sellerTaxCode", "buyerTaxCode")},
        **{f"{c}_not_in_source": not_in_source(col(c), text, c.endswith("TaxCode")) for c in CRITICAL},
    }
    flags = F.concat(item_math_flags(F.col("items")), F.array_compact(F.array(*[F.when(v, k) for k, v in single.items()])))
    shown = [c for c, t in invoices.dtypes if t in ("string", "double") and c not in ("raw_text", "zoom_text")]
    levels = F.map_filter(F.create_map(*[x for c in shown for x in (F.lit(c), confidence(F.col(c).cast("string"), text))]), lambda k, v: v.isNotNull())
    return invoices.withColumn("flags", flags).withColumn("confidence", levels)


def summary(validated: DataFrame, *keys: str) -> DataFrame:
    """Numbers of flags and of fields of each level, and the names of low fields."""
    count = lambda level: F.size(F.filter(F.map_values("confidence"), lambda v: v == level)).cast("long")
    return validated.select(
        *keys, F.size("flags").cast("long").alias("total_flags"), F.array_join(F.array_sort("flags"), ",").alias("flag_names"),
        count("HIGH").alias("confidence_high"), count("MEDIUM").alias("confidence_medium"), count("LOW").alias("confidence_low"),
        F.array_join(F.array_sort(F.map_keys(F.map_filter("confidence", lambda k, v: v == "LOW"))), ",").alias("low_fields"),
    )


def derived_tax(pre_tax: Column, percent: Column) -> tuple[Column, Column]:
    """(tax, total) from a pre-tax sum and a rate."""
    tax = F.bround(pre_tax * percent / 100, 2)
    return tax, pre_tax + tax


def tax_bucket(pre_tax: Column, tax: Column) -> Column:
    """The rate of two sums, if rounding gives one that is in use."""
    rate = F.bround(tax / pre_tax * 100, 0).cast("int")
    return F.when((pre_tax > 0) & (tax > 0) & rate.isin(1, 2, 3, 5, 8, 10, 15, 20), rate)


def last_three_agree(numbers: Column) -> Column:
    """Whether the last three numbers are pre-tax, tax and total, within 1 % and 10."""
    pre, tax, total = (F.try_element_at(numbers, F.lit(k)) for k in (-3, -2, -1))
    return F.coalesce(F.abs(pre + tax - total) <= total * 0.01 + 10, F.lit(False))


def without_year(total: Column) -> Column:
    """Null for a total that looks like a year."""
    return F.when(~((total >= 1900) & (total <= 2100) & (total == F.floor(total))), total)


def total_or_words(total: Column, words: Column, items_sum: Column) -> Column:
    """The amount in words, where the total is far from it and does not match the items."""
    far = (words > 0) & ((total < 0.5 * words) | (total > 1.5 * words))
    matches = (items_sum > 0) & (F.abs(total - items_sum) <= 0.05 * items_sum + 10)
    return F.when(total.isNull() & (words > 0), words).when(far & ~F.coalesce(matches, F.lit(False)), words).otherwise(total)
