"""Line items out of document text: pipe tables, HTML tables and plain lines.

Everything is a projection within a row, so nothing is shuffled. Plain lines are expressions over arrays; tables, whose rows
are told by what came before, are read by Python in Arrow batches of bounded size, all kinds in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.numbers import stripped
from foliospark.operators import html_table, pipe_table, text_items
from foliospark.operators.reader import batches as by_bytes
from foliospark.operators.reader import with_fields

ITEM = "struct<productCode:string,productName:string,unit:string,unitPrice:double,quantity:double,amount:double,discountPercent:string,discountAmount:double,payment:double>"
ITEMS = f"array<{ITEM}>"
_ARROW_ITEMS = pa.list_(pa.struct([(n, pa.float64() if k == "double" else pa.string()) for n, k in (x.split(":") for x in ITEM[7:-1].split(","))]))

# Names of rows that are no items.
GARBAGE_WORDS = ["thời điểm", "thuế suất", "tổng cộng", "cộng tiền", "thành tiền trước thuế", "không kê khai", "không chịu thuế", "tiền thuế", "số tiền viết bằng chữ", "người mua", "người bán", "chữ ký", "signature", "incoterm", "ex works", "despatch mode", "parcel nr", "gross weight"]
CURRENCY_NAMES = "usd eur gbp vnd jpy cny inr aud cad sgd chf hkd twd krw thb myr idr php sek nok dkk nzd zar aed sar brl mxn pln czk try rub".split()
ITEM_SUMMARIES = ["sub total", "subtotal", "grand total", "total", "tax total", "taxal", "vat", "net total", "balance due", "amount due", "tổng cộng", "cộng tiền", "thuế"]
DELIVERY_TERMS = "exw fob cif cfr cip cnf dap ddp fca".split()


def _any(words: list[str]) -> str:
    """A pattern for any of the words."""
    return "|".join(re.escape(w).replace("/", r"\/") for w in words)


def _no_items() -> Column:
    return F.array().cast(ITEMS)


def _item(**fields: Column) -> Column:
    names = ["productCode", "productName", "unit", "unitPrice", "quantity", "amount", "discountPercent", "discountAmount", "payment"]
    return F.struct(*[fields.get(n, F.lit(None)).alias(n) for n in names]).cast(ITEM)


def _low(text: Column) -> Column:
    return F.lower(stripped(text))


def html_of(text: str | None) -> list[dict]:
    return html_table.items_of(text) if text and "<" in text else []


def pipe_of(text: str | None) -> list[dict]:
    return pipe_table.items_of(text) if text and "|" in text else []


def loose_of(text: str | None) -> list[dict]:
    return text_items.items_of(text)[1] if text and "<table" not in text else []


def plain_of(text: str | None) -> list[dict]:
    """plain_items() of one text."""
    out = []
    for line in (text or "").split("\n"):
        numbers = re.findall(r"\d[\d.,]*", line) if re.match(r"[0-9]+[ \t\n\x0b\f\r]+", line) else []
        if len(numbers) >= 3:
            name = line
            for n in numbers[-3:]:
                name = name.replace(n, "")
            q, p, a = (float(x.replace(".", "").replace(",", "")) for x in numbers[-3:])
            out.append({n: None for n in pipe_table.NAMES} | {"productName": name.strip(), "quantity": q, "unitPrice": p, "amount": a})
    return out


READERS = (html_of, pipe_of, loose_of, plain_of)


def read_items(text: str | None) -> list[dict]:
    """The items of an HTML table, else of a pipe table, else of structured text, else of plain lines."""
    return next((x for read in READERS if (x := read(text))), [])


def with_read_items(df: DataFrame, text_col: str, out: str, *readers: Callable[[str | None], list[dict]]) -> DataFrame:
    """df with the items of the first of the readers that finds any in the text; an empty array without. Whole texts go to Python in Arrow batches; other columns pass as they are."""
    place, names = df.columns.index(text_col), [*df.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, [place]):
            found = [next((x for read in readers if (x := read(t))), []) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW_ITEMS)], names)

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, item_type())]))


def with_pipe_items(df: DataFrame, text_col: str, out: str = "items") -> DataFrame:
    """df with the items of the text's pipe table."""
    return with_read_items(df, text_col, out, pipe_of)


def with_html_items(df: DataFrame, text_col: str, out: str = "items") -> DataFrame:
    """df with the items of the text's first HTML table."""
    return with_read_items(df, text_col, out, html_of)


def item_type() -> T.ArrayType:
    kinds = {"double": T.DoubleType(), "string": T.StringType()}
    return T.ArrayType(T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in ITEM[7:-1].split(","))]))


def row_reasons(df: DataFrame, text_col: str, out: str = "reasons") -> DataFrame:
    """df with why each row of the text's pipe table is no item, null for items; rules and units told as any other row."""
    kind = T.StructType([T.StructField(out, T.ArrayType(T.StringType()))])
    return with_fields(df, [text_col], kind, lambda text: {out: [pipe_table.reason(pipe_table.cells_of(x)) for x in pipe_table.logical_rows(text or "")]})


def plain_items(text: Column) -> Column:
    """Items of lines that start with a number and hold three or more: the last three are quantity, price and amount, all separators dropped."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"^\d+\s+"))
    found = F.filter(F.transform(lines, lambda x: F.struct(x.alias("line"), F.regexp_extract_all(x, F.lit(r"\d[\d.,]*"), F.lit(0)).alias("n"))), lambda r: F.size(r["n"]) >= 3)
    number = lambda r, k: F.translate(F.element_at(r["n"], k), ".,", "").try_cast("double")
    name = lambda r: stripped(F.aggregate(F.slice(r["n"], -3, 3), r["line"], lambda a, n: F.replace(a, n, F.lit(""))))
    return F.transform(found, lambda r: _item(productName=name(r), quantity=number(r, -3), unitPrice=number(r, -2), amount=number(r, -1)))


def with_items(df: DataFrame, text_col: str, out: str = "items") -> DataFrame:
    """df with the items of an HTML table, else of a pipe table, else of structured text, else of plain lines."""
    return with_read_items(df, text_col, out, *READERS)


def without_garbage(items: Column) -> Column:
    """Items that carry data and whose name is no label, currency, delivery term, carrier or bare row number."""

    def good(x: Column) -> Column:
        low = F.lower(F.coalesce(x["productName"], F.lit("")))
        name = stripped(F.regexp_replace(stripped(low), r"^-+|-+$", ""))
        empty = x["quantity"].isNull() & x["unitPrice"].isNull() & x["amount"].isNull()
        full = x["quantity"].isNotNull() & x["unitPrice"].isNotNull() & x["amount"].isNotNull()
        term = stripped(F.regexp_replace(name, ":+$", "")).isin(*DELIVERY_TERMS)
        bad = (
            empty
            | low.rlike(_any(GARBAGE_WORDS))
            | stripped(low).isin(*CURRENCY_NAMES)
            | name.isin(*ITEM_SUMMARIES)
            | ((name == "") & x["unitPrice"].isNull())
            | term
            | (F.translate(name, ".,", "").rlike(r"^\d+$") & (F.length(name) <= 5) & ~full)
            | (F.abs(F.coalesce(x["amount"], F.lit(0.0))) > 1e12)
            | ((F.length(name) < 30) & name.rlike("^(?:fedex|dhl |ups |forwarder|transporteur)"))
        )
        return ~bad

    return F.filter(items, good)


def collapsed_double(items: Column) -> Column:
    """Half of a list of four or more whose halves agree in their amounts."""
    n = F.size(items)
    half = (n / 2).cast("int")
    amounts = lambda start: F.transform(F.slice(items, start, half), lambda x: x["amount"])
    same = F.forall(F.zip_with(amounts(F.lit(1)), amounts(half + 1), lambda a, b: a.eqNullSafe(b)), lambda x: x)
    return F.when((n >= 4) & (n % 2 == 0) & same, F.slice(items, F.lit(1), half)).otherwise(items)


def amount_sum(items: Column) -> Column:
    """Sum of the amounts, none as zero."""
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x["amount"], F.lit(0.0)))
