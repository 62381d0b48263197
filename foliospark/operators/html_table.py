"""Rows of HTML tables as they come: tags in any case, cells and rows that nothing closes, tables in cells, entities of all kinds.

A text is cut into tags, comments and what stands between them in one pass. A stack of what is open is all that is kept: a cell ends where the next
begins, a row where the next row or a section does, all where their table ends or the text does. A table within a cell is text of that cell.
As in a document tree, a cell's text is that of its pieces, each without the white space around it; a cell that spans columns is one cell.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

from foliospark.functions.plain import number, quantity
from foliospark.operators.pipe_table import NAMES

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>|<[!?][^>]*+>""", re.S)
_SECTIONS = {"thead", "tbody", "tfoot", "caption", "colgroup"}
_RAW = {tag: re.compile(f"</{tag}", re.I) for tag in ("script", "style")}
# What the first cell of a summary says.
SUMMARIES = ["tổng hợp", "cộng tiền", "thuế suất", "không chịu thuế", "không kê khai"]


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """("text", piece), ("open", tag) and ("close", tag) in order; a tag that doesn't end is text."""
    at, last = 0, text.rfind(">") + 1
    while m := _TAG.search(text, at, last):
        if m.start() > at:
            yield "text", text[at : m.start()]
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            yield "close" if m[1] else "open", tag
            if tag in _RAW and not m[1]:  # nothing counts up to its end
                end = _RAW[tag].search(text, at)
                at = end.start() if end else len(text)
    if at < len(text):
        yield "text", text[at:]


class _Table:
    """The rows of the table that is open, and what of it is still open."""

    def __init__(self):
        self.rows: list[list[str]] = []
        self.row: list[str] | None = None
        self.cell: list[str] | None = None
        self.inner = 0  # tables in the cell that is open

    def end_cell(self) -> None:
        if self.cell is not None and self.row is not None:
            self.row.append("".join(self.cell))
        self.cell = None

    def end_row(self) -> None:
        self.end_cell()
        if self.row is not None:
            self.rows.append(self.row)
        self.row = None

    def open(self, tag: str) -> None:
        if tag == "tr" or tag in _SECTIONS:
            self.end_row()
            self.row = [] if tag == "tr" else None
        elif tag in ("td", "th"):
            self.end_cell()
            self.row = [] if self.row is None else self.row
            self.cell = [] if tag == "td" else None

    def close(self, tag: str) -> None:
        if tag in ("td", "th"):
            self.end_cell()
        elif tag == "tr" or tag in _SECTIONS:
            self.end_row()


def first_table(text: str) -> list[list[str]]:
    """The cells of each row of the first table; headings are no cells."""
    now = None
    for what, x in tokens(text):
        if now is None:
            now = _Table() if (what, x) == ("open", "table") else None
        elif what == "text":
            if now.cell is not None and (piece := (unescape(x) if "&" in x else x).strip()):
                now.cell.append(piece)
        elif x == "table":
            if what == "close" and not now.inner:
                break
            # Without an open cell a table in a table begins the rows anew, as its parser would put it before.
            now.inner += (1 if what == "open" else -1) if now.cell is not None or now.inner else 0
        elif not now.inner:
            (now.open if what == "open" else now.close)(x)
    if now is None:
        return []
    now.end_row()
    return now.rows


def items_of(text: str | None) -> list[dict]:
    """Items of the first table by place, behind its first row; of rows of six cells and more those with a number."""
    out = []
    for c in first_table(text)[1:] if text and "<table" in text.lower() else []:
        low = [x.lower() for x in c]
        bare = [x.strip("()") for x in c[:5]]
        if len(c) < 6 or any(w in low[0] for w in SUMMARIES) or (_digits(bare[0]) and all(_digits(b) or "=" in x or "x" in x for b, x in zip(bare, low, strict=False))):
            continue
        q, p, a = quantity(c[3]), number(c[4]), number(c[5])
        if q is None and p is None and a is None:
            continue
        paid = number(c[8]) if len(c) >= 9 else None
        found = {"productName": c[1] or None, "unit": c[2] if c[2] and (number(c[2]) or 0.0) <= 1000 else None, "quantity": q, "unitPrice": p, "amount": a}
        found |= {"discountPercent": c[6] or None if len(c) >= 8 else None, "payment": paid or None}
        out.append({n: found.get(n) for n in NAMES})
    return out


def _digits(x: str) -> bool:
    return re.fullmatch(r"[0-9]+", x) is not None
