"""The engine in Spark SQL: functions of texts and numbers, and the items of a text as a table for LATERAL.

register(spark) makes them known to a session; functions run in Arrow batches. Column functions of the same names in functions/ stay inside
the JVM and are the ones to use from DataFrames.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions import plain


_NUMBER, _TEXT = T.DoubleType(), T.StringType()
#: Functions of a text or number, and what they give.
FUNCTIONS: dict[str, tuple[Callable, T.DataType]] = {
    "parse_number": (plain.number, _NUMBER),
    "parse_quantity": (plain.quantity, _NUMBER),
    "parse_price": (plain.price, _NUMBER),
    "amount_in_words": (plain.amount_in_words, _TEXT),
    "vn_words_to_number": (plain.vn_words_to_number, _NUMBER),
    "en_words_to_number": (plain.en_words_to_number, _NUMBER),
    "number_to_vn_words": (plain.number_to_vn_words, _TEXT),
    "number_to_en_words": (plain.number_to_en_words, _TEXT),
}


def _mapped(f: Callable, kind: T.DataType):
    made = pa.float64() if kind == _NUMBER else pa.string()

    def run(x: pa.Array) -> pa.Array:
        return pa.array([f(v) for v in x.to_pylist()], made)

    return F.arrow_udf(run, kind)


def _document_date(text: pa.Array, day_first: pa.Array) -> pa.Array:
    return pa.array([plain.document_date(t, bool(d)) for t, d in zip(text.to_pylist(), day_first.to_pylist(), strict=True)], pa.string())


ITEMS = "place int, productCode string, productName string, unit string, unitPrice double, quantity double, amount double"


class InvoiceItems:
    """The items of one text, in order: of its HTML table, else its pipe table, else text without tables, else plain lines."""

    def eval(self, text: str):
        from foliospark.operators import items

        for k, x in enumerate(items.read_items(text)):
            yield (k, *(x.get(c.split()[0]) for c in ITEMS.split(", ")[1:]))


def register(spark: SparkSession) -> None:
    """FUNCTIONS, document_date(text, day first) and the table function invoice_items, by their names, in this session. A text's few items are a table of their own in Arrow, which costs more than reading them; the table function goes without."""
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(name, _mapped(f, kind))
    spark.udf.register("document_date", F.arrow_udf(_document_date, _TEXT))
    spark.udtf.register("invoice_items", F.udtf(InvoiceItems, returnType=ITEMS, useArrow=False))
