"""A reader of labelled values: what documents of any kind are read with.

A rule names a field, the part of the document where it may stand, the phrases that label it and the kind of its
value. From phrases and kinds the reader makes its patterns; a document's lines are gone through once for each part.
Readers run in Arrow batches of whole texts: a document is a row, and nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes of text that are read at once.
BATCH = 4_000_000

_DAY_NAMED, _YEAR_FIRST = r"\d{2}[A-Z]{3}\d{4}", r"\d{4}/\d{2}/\d{2}"
#: Kinds of values; capital letters are told from small ones.
KINDS = {
    "code": r"[A-Z0-9]+",
    "long code": r"[A-Z0-9]{5,}",
    "numeric code": r"[0-9\-]+",
    "twelve digits": r"\d{12}",
    "phone": r"[+\d\-\s]+",
    "container": r"[A-Z]{4}\d{7}",
    "seal": r"[A-Z]?\d{5,}",
    "weight": r"(?<![\d,.])\d[\d,.]+\s*(?i:kgs|kgm|kg)",
    "volume": r"(?<![\d,.])\d[\d,.]+\s*(?i:cbm|m[³3])",
    "tariff": r"\d[\d.]{3,}",
    "pieces": r"(?<!\d)\d+\s*(?i:package|pallet|case|carton|sets|pcs)",
    "movement": r"(?i:c[yf]s?-c[yf]s?)\b",
    "any movement": r"(?i:c[yf]s?\s*[-/]\s*c[yf]s?|[fl]cl\s*[-/]\s*[fl]cl)\b",
    "term": r"(?i:fob|cif|cfr|c\.?f\.?r|cip|fca|exw|dap|ddp)\b",
    "freight": r"(?i:freight (?:collect|prepaid))",
    "shipping day": rf"{_DAY_NAMED}|{_YEAR_FIRST}",
    "any day": rf"{_YEAR_FIRST}|{_DAY_NAMED}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}[-/]\w{{3}}[-/]\d{{4}}|\w+ \d{{1,2}},?\s*\d{{4}}",
    "slashed day": r"\d{1,2}/\d{1,2}/\d{4}",
    "voyage": r"[A-Z][A-Z\s]+\d{3,}[A-Z]*(?:/\s*\d+[A-Z]*)?",
    "cell": r"[^|]+",
    "rest": r".+",
}


@dataclass(frozen=True)
class Rule:
    """`near`: the value stands right behind its label and separators; else anywhere behind it in the line. No labels: anywhere in the line.

    Phrases in `unless` are not behind the label in the line.
    """

    field: str
    part: str | None
    labels: tuple[str, ...]
    kind: str
    near: bool = True
    unless: tuple[str, ...] = ()
    upper: bool = False


@cache
def phrase(words: str) -> str:
    """A pattern for a phrase: any white space between its words, a point where words are short, case folded."""
    return r"\s*".join(re.escape(w) + (r"\.?" if len(w) <= 3 else "") for w in words.split())


@cache
def pattern(rule: Rule) -> re.Pattern:
    value = f"(?P<value>{KINDS[rule.kind]})"
    if not rule.labels:
        return re.compile(rf"(?<![A-Za-z]){value}")
    label = "(?i:" + "|".join(phrase(x) for x in sorted(rule.labels, key=len, reverse=True)) + ")"
    stop = "(?!.*(?i:" + "|".join(map(phrase, rule.unless)) + "))" if rule.unless else ""
    return re.compile(rf"{label}{r'[.:\s]*' if rule.near else '.*?'}{stop}{value}")


def first(rule: Rule, lines: list[str]) -> str | None:
    """The rule's value in the first line that has one."""
    find = pattern(rule).search
    for line in lines:
        if (m := find(line)) and (value := m["value"].strip().rstrip(",").rstrip()):
            return re.sub(r"[\s.]", "", value).upper() if rule.upper and rule.kind != "freight" else value.upper() if rule.upper else value
    return None


def read(rules: list[Rule], parts: dict[str | None, list[str]], into: dict[str, str | None]) -> None:
    """The first rule of a field that finds a value gives it; what `into` has stays."""
    for rule in rules:
        if not into.get(rule.field) and (lines := parts.get(rule.part)) and (value := first(rule, lines)):
            into[rule.field] = value


def behind_colon(line: str) -> str | None:
    return line.partition(":")[2].strip() or None


def batches(found: Iterator[pa.RecordBatch], columns: list[int], size: int = BATCH) -> Iterator[pa.RecordBatch]:
    """Batches cut to about `size` bytes of text, a row at least."""
    for batch in found:
        sized = [k for k in columns if pa.types.is_string(batch.column(k).type) or pa.types.is_binary(batch.column(k).type)]
        held = [pc.fill_null(pc.binary_length(batch.column(k)), 0).to_pylist() for k in sized] or [[8] * batch.num_rows]
        start, total = 0, 0
        for k, row in enumerate(zip(*held, strict=True)):
            total += sum(row)
            if total > size and k > start:
                yield batch.slice(start, k - start)
                start, total = k, sum(row)
        if batch.num_rows > start:
            yield batch.slice(start)


def with_fields(docs: DataFrame, texts: list[str], fields: T.StructType, parse: Callable[..., dict]) -> DataFrame:
    """docs with the fields that parse(*texts) finds in each row. Fields replace columns of their names."""
    kept = [c for c in docs.columns if c not in fields.names or c in texts]
    narrow = docs.select(*kept)
    at, out = [narrow.columns.index(t) for t in texts], [f for f in fields if f.name not in kept]
    arrow = _arrow(T.StructType(out))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(found, at):
            rows = [parse(*row) for row in zip(*(batch.column(k).to_pylist() for k in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r.get(f.name) for r in rows], f.type) for f in arrow)], [*kept, *arrow.names])

    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields, *out]))


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
