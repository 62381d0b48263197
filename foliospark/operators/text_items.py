"""Line items of texts without a table: labels with values, and lines that hold a product with its figures.

A reader is tried on the whole text; the first that gives an item is taken, and its name is kept with the items.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from foliospark.functions.plain import number, price, quantity, without_brackets
from foliospark.operators.pipe_table import NAMES, cells_of, kind
from foliospark.operators.reader import with_fields

# Labels of an item's fields.
LABELS = {
    "productName": ["description", "description of goods", "goods", "product", "product name", "item", "tên hàng", "commodity", "diễn giải"],
    "productCode": ["product code", "code", "hs code", "mã hàng"],
    "quantity": ["quantity", "qty", "số lượng"],
    "unit": ["unit", "đvt"],
    "unitPrice": ["unit price", "price", "đơn giá"],
    "amount": ["amount", "total value", "line total", "thành tiền"],
}
UNITS = "pcs|pc|sets?|kgs?|mts?|ctns?|cartons?|boxes|bags|rolls|units?|pairs|dozen|drums|ea"
SUMS = ["total", "subtotal", "sub total", "grand total", "cộng", "tổng"]
_FIELD = {label: f for f, labels in LABELS.items() for label in labels}
_READ: dict[str, Callable] = {"quantity": quantity, "unitPrice": price, "amount": number, "productName": str, "productCode": str, "unit": str}
_MONEY = r"(?:USD|EUR|GBP|[$€£])?\s*+(\d[\d,]*(?:\.\d+)?)"
_COUNTED = re.compile(rf"(\d[\d,.]*+)\s*+(?:({UNITS})\b)?", re.I)


def _plain(line: str) -> str:
    return re.sub(r"\*\*([^*]*)\*\*", r"\1", line).strip().strip("*#").strip()


def _field(text: str) -> str | None:
    return _FIELD.get(without_brackets(text).strip(" :*.").lower())


def _sum(name: str | None) -> bool:
    return not name or any(name.lower().startswith(s) for s in SUMS)


def labelled_pairs(lines: list[str]) -> list[dict]:
    """`Description: x`, `Quantity: 2`...: a label that comes again begins the next item."""
    out: list[dict] = [{}]
    for line in lines:
        label, colon, value = _plain(line).partition(":")
        field = _field(label) if colon and value.strip() else None
        if field:
            if field in out[-1]:
                out.append({})
            out[-1][field] = _READ[field](value.strip())
    return out


def labels_then_values(lines: list[str]) -> list[dict]:
    """Labels below one another, then values in the same order, again and again."""
    text = [x for x in map(_plain, lines) if x]
    for start in range(len(text)):
        fields = []
        while start + len(fields) < len(text) and (f := _field(text[start + len(fields)])) and f not in fields:
            fields.append(f)
        if len(fields) < 3:
            continue
        values = text[start + len(fields) :]
        out = []
        for k in range(0, len(values) - len(fields) + 1, len(fields)):
            item = {f: _READ[f](v) for f, v in zip(fields, values[k:], strict=False)}
            if any(f in item and item[f] is None for f in ("quantity", "unitPrice", "amount")) or _sum(item.get("productName")):
                break
            out.append(item)
        return out
    return []


def numbered_sections(lines: list[str]) -> list[dict]:
    """`Description:` `Quantity:` `Unit price:` `Amount:` as headings over numbered lists, which belong together by their numbers."""
    lists: dict[str, dict[int, str]] = {}
    now = None
    for line in map(_plain, lines):
        heading = _field(line.rstrip(":"))
        m = re.match(r"(\d{1,3})[.)]\s*(.+)", line)
        if heading:
            now = heading
        elif m and now:
            lists.setdefault(now, {})[int(m[1])] = m[2]
    names = lists.pop("productName", {})
    return [{"productName": name} | {f: _READ[f](values[k]) for f, values in lists.items() if k in values} for k, name in sorted(names.items())] if lists else []


def numbered_lines(lines: list[str]) -> list[dict]:
    """`1. name` with quantity, unit and price in the line or in the two below."""
    out = []
    for k, line in enumerate(map(_plain, lines)):
        m = re.match(r"\d{1,3}[.)]\s+(\D.*)", line)
        if not m:
            continue
        block = []
        for below in map(_plain, lines[k + 1 : k + 3]):
            if re.match(r"\d{1,3}[.)]\s", below) or _sum(below or None):
                break
            block.append(below)
        figures = " ".join([m[1], *block])
        counted = next((c for c in _COUNTED.finditer(figures) if c[2]), None)
        priced = re.search(rf"(?i)(?<!\w)(?:@|x|at|unit price:?)\s*+{_MONEY}", figures)
        if counted and priced:
            name = m[1][: m[1].find(counted[0])].strip(" ,-:") if counted[0] in m[1] else m[1].strip()
            q, p = number(counted[1]), number(priced[1])
            out.append({"productName": name, "quantity": q, "unit": counted[2], "unitPrice": p, "amount": round(q * p, 2) if q is not None and p is not None else None})
    return out


def capital_lines(lines: list[str]) -> list[dict]:
    """`STEEL PIPE 10 PCS USD 5.00 USD 50.00`: a name in capitals, a quantity with its unit, then price and amount or the amount alone."""
    out = []
    for line in map(_plain, lines):
        m = re.match(rf"([A-Z][A-Z0-9 ,./()#-]*?[A-Z])\s+(\d[\d,.]*)\s*({UNITS})\b(.*)$", line, re.I)
        if not m or m[1].upper() != m[1] or _sum(m[1]):
            continue
        found = [v for x in re.findall(r"\d[\d,]*(?:\.\d+)?", m[4]) if (v := number(x)) is not None]
        if found:
            q = number(m[2])
            out.append({"productName": m[1], "quantity": q, "unit": m[3], "unitPrice": found[0] if len(found) > 1 else None, "amount": found[-1]})
    return out


def bold_blocks(lines: list[str]) -> list[dict]:
    """A name in bold and its figures below it, up to the next one."""
    out: list[dict] = []
    for line in lines:
        m = re.fullmatch(r"\s*\*\*([^*:]+)\*\*\s*", line)
        if m:
            out.append({"productName": m[1].strip(), "figures": []})
        elif out:
            out[-1]["figures"] += [v for x in re.findall(r"\d[\d,]*(?:\.\d+)?", line) if (v := number(x)) is not None]
    items = []
    for item in out:
        figures = item.pop("figures")
        if len(figures) >= 3 and not _sum(item["productName"]) and abs(figures[0] * figures[1] - figures[2]) <= 0.5:
            items.append(item | {"quantity": figures[0], "unitPrice": figures[1], "amount": figures[2]})
    return items


def last_decimal(lines: list[str]) -> list[dict]:
    """Rows of pipes that no header names: the first words are the name, the last number with decimals is the amount."""
    out = []
    for line in lines:
        cells = cells_of(line) if "|" in line and kind(line) == "row" else []
        name = next((c for c in cells if re.search(r"[^\W\d]{3}", c)), None)
        amounts = [c for c in cells if re.fullmatch(rf"{_MONEY}", c) and re.search(r"\.\d{2}$", c)]
        if name and amounts and not _sum(name):
            out.append({"productName": name, "amount": number(amounts[-1])})
    return out


READERS: list[tuple[str, Callable[[list[str]], list[dict]]]] = [
    ("labelled pairs", labelled_pairs), ("labels then values", labels_then_values), ("numbered sections", numbered_sections), ("numbered lines", numbered_lines),
    ("capital lines", capital_lines), ("bold blocks", bold_blocks), ("last decimal", last_decimal),
]


def items_of(text: str | None) -> tuple[str | None, list[dict]]:
    """(reader, items): items have a name and a figure, and no sum's name; (null, none) where no reader finds one."""
    lines = (text or "").replace("\\n", "\n").split("\n")
    for name, read in READERS:
        found = [x for x in read(lines) if not _sum(x.get("productName")) and any(x.get(f) is not None for f in ("quantity", "unitPrice", "amount"))]
        if found:
            return name, [{n: x.get(n) for n in NAMES} for x in found]
    return None, []


def with_text_items(df: DataFrame, text_col: str, items_type: T.ArrayType, out: str = "items", reader: str = "reader") -> DataFrame:
    """df with the items of texts without tables and the reader that found them."""
    schema = T.StructType([T.StructField(reader, T.StringType()), T.StructField(out, items_type)])
    return with_fields(df, [text_col], schema, lambda text: dict(zip((reader, out), items_of(text), strict=True)))
