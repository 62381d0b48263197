"""Numbers as business documents write them, as Column functions without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What may stand before a number.
CURRENCY_SIGNS = "$€£¥₹₩฿₺₽₱﷼"
CURRENCY_CODES = "VND|USD|EUR|GBP|JPY|CNY|KRW|THB|INR|AUD|CAD|SGD|HKD|MYR|IDR|PHP"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: it is bound as a lambda's variable, so that expressions grow by use and not by size."""
    return F.get(F.transform(F.array(value), body), 0)


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def none_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without one, or where the group is empty."""
    return none_if_empty(F.regexp_extract(text, pattern, group))


def parse_number(text: Column) -> Column:
    """A number whose separators tell its locale: of two kinds the later one is decimal, except a comma before just three digits; a lone dot
    before three digits parts thousands; a lone comma before one or two digits, or behind a zero, is decimal. Sign and other characters are dropped."""
    v = stripped(F.regexp_replace(stripped(text), f"^[{CURRENCY_SIGNS}]+", ""))
    return let(stripped(F.regexp_replace(v, f"(?i)^(?:{CURRENCY_CODES})\\s*", "")), _plain_number)


def _plain_number(v: Column) -> Column:
    bare = lambda x, chars: F.translate(x, chars, "")
    point = lambda x: F.translate(x, ",", ".")
    both = F.when(v.rlike(r",\d{3}$"), bare(v, ".,")).when(v.rlike(r",[^.,]*$"), point(bare(v, "."))).otherwise(bare(v, ","))
    commas = F.when(v.rlike(r"^[^,]*,[^,]{0,2}$") | v.rlike(r"^-*0,[^,]*$"), point(v)).otherwise(bare(v, ","))
    last = F.concat(bare(F.regexp_extract(v, r"^(.*)\.[^.]*$", 1), "."), F.lit("."), F.regexp_extract(v, r"([^.]*)$", 1))
    dots = F.when(v.rlike(r"\.\d{3}$"), bare(v, ".")).when(v.rlike(r"\..*\."), last).otherwise(v)
    plain = F.when(v.contains("."), F.when(v.contains(","), both).otherwise(dots)).when(v.contains(","), commas).otherwise(v)
    return F.regexp_replace(plain, r"[^\d.]", "").try_cast("double")


def parse_quantity(text: Column) -> Column:
    """parse_number(), but `4 x 5` multiplies."""
    product = r"(\d+)\s*[x×]\s*(\d+)"
    return let(text, lambda x: F.when(x.rlike(product), found(x, product, 1).try_cast("double") * found(x, product, 2).try_cast("double")).otherwise(parse_number(x)))


def parse_price(text: Column) -> Column:
    """parse_number(), but with one dot, three decimals and an integer part under 100 the dot is decimal."""
    bare = lambda x: F.translate(F.regexp_replace(stripped(x), r"^[$€£¥]+", ""), ",", "")
    return let(text, lambda x: let(bare(x), lambda v: F.when(v.rlike(r"^0*\d{1,2}\.\d{3}$"), v.try_cast("double")).otherwise(parse_number(x))))


def tax_percent(value: Column) -> Column:
    """A number as a percentage: 10.0 as `10%`, 10.5 as `10.5%`."""
    return F.when(value == F.floor(value), F.concat(value.cast("bigint").cast("string"), F.lit("%"))).otherwise(F.concat(value.cast("string"), F.lit("%")))


def local_phone(text: Column) -> Column:
    """Digits of a phone number, the country code 84 as 0."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(digits.startswith("84"), F.concat(F.lit("0"), F.substr(digits, F.lit(3)))).otherwise(digits)
