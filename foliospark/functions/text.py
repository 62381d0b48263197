"""Cleaning of recognised text and small scalars over it."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import found, none_if_empty, stripped

# What ends an amount in words.
STOP_MARKERS = [
    "người mua hàng", "người bán hàng", "tra cứu", "website", "phát hành bởi", "chữ ký", "misa", "viettel", "vnpt", "cần kiểm tra", "đối chiếu",
    "https://", "http://", "www.", "(ký,", "_", "*", "customer", "seller", "buyer",
]


def clean_rawtext(text: Column) -> Column:
    """Without grounding tags and what they hold; carriage returns as line ends, blank lines collapsed."""
    for tag in ("ref", "det"):
        text = F.regexp_replace(text, rf"(?s)<\|{tag}\|>.*?<\|/{tag}\|>", "")
    return stripped(F.regexp_replace(F.translate(text, "\r", "\n"), r"\n{2,}", "\n"))


# Grounding tags in pairs and alone, bold text, heads of headings, and what stays of them.
MARKUP = [(r"<\|ref\|>.*?<\|/ref\|><\|det\|>.*?<\|/det\|>", ""), (r"<\|[^>]+\|>", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"(?m)^#+[^\S\n]*", "")]


def _unmarked(text: Column) -> Column:
    return reduce(lambda t, x: F.regexp_replace(t, *x), MARKUP, F.replace(text, F.lit("\\n"), F.lit("\n")))


def shipping_lines(text: Column) -> Column:
    """Lines without markup, blanks and table rules."""
    lines = F.transform(F.split(_unmarked(text), r"[\n\r\x0b\f\x1c-\x1e\x85  ]"), stripped)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^\|[-\s|]+\|$"))


def invoice_lines(text: Column) -> Column:
    """shipping_lines() without lone quotes; a quote at one end only is dropped."""
    head, tail = (lambda x: x.startswith('"')), (lambda x: x.endswith('"'))
    lines = F.filter(shipping_lines(text), lambda x: x != '"')
    fixed = F.transform(lines, lambda x: F.when(head(x) & ~tail(x), stripped(F.regexp_replace(x, '^"', ""))).when(tail(x) & ~head(x), stripped(F.regexp_replace(x, '"$', ""))).otherwise(x))
    return F.filter(fixed, lambda x: x != "")


def before_markers(lines: Column, *markers: str) -> Column:
    """The lines before the first that holds one of the patterns."""
    flags = F.transform(lines, lambda x: reduce(lambda a, b: a | b, (x.rlike(m) for m in markers)))
    at = F.array_position(flags, True)
    return F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)


def first_page(lines: Column) -> Column:
    """Without zoomed text and without what follows the mark of a page from two on (a mark of a page that begins with 1 does not end it)."""
    return before_markers(lines, r"--- ?ZOOM TEXT ?---", r"--- ?ZOOM RIGHT ?---", r"(?i)^---\s*PAGE\s+[2-9]\d*\s*---")


def pages_of(text: Column) -> Column:
    """Page texts between page marks, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, r"--- PAGE \d+ ---\n?"), stripped), lambda x: x != "")


def selected_pages(selection: Column, count: Column) -> Column:
    """Zero-based pages of a selection such as `1,3-5`: sorted, distinct, clamped; all pages if nothing valid is named."""
    every = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    part = lambda x: F.regexp_replace(x, r"\s", "")
    ends = lambda x: (F.greatest(F.lit(1), found(part(x), r"^(\d+)-(\d+)$", 1).try_cast("int")), F.least(count, found(part(x), r"^(\d+)-(\d+)$", 2).try_cast("int")))
    one = lambda x: found(part(x), r"^(\d+)$").try_cast("int")

    def picked(x: Column) -> Column:
        low, high = ends(x)
        single = F.when(one(x).between(1, count), F.array(one(x) - 1))
        span = F.when(part(x).rlike(r"^\d+-\d+$") & (low <= high), F.sequence(low - 1, high - 1))
        return F.coalesce(span, single, F.array().cast("array<int>"))

    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(F.coalesce(selection, F.lit("")), ","), picked))))
    return F.when(F.size(chosen) > 0, chosen).otherwise(every)


def amount_in_words(text: Column) -> Column:
    """An amount in words without table marks, cut at each marker that stands behind ten characters, without trailing points."""
    flat = F.regexp_replace(F.replace(F.translate(text, "|\n", "  "), F.lit("\\n"), F.lit(" ")), r"(?U)\s+", " ")
    # One marker a step, so that each is sought in what the one before has left.
    kept = F.aggregate(F.array(*map(F.lit, STOP_MARKERS)), flat, lambda a, m: F.when(F.position(m, F.lower(a)) > 11, F.substring(a, F.lit(1), F.position(m, F.lower(a)) - 1)).otherwise(a))
    trimmed = stripped(F.regexp_replace(stripped(kept), r"[.,:;]+$", ""))
    return F.coalesce(F.regexp_replace(trimmed, r"(?iu)(chẵn)\s*\.?\s*$", "$1"), F.lit(""))


def without_thoughts(text: Column) -> Column:
    """A model's answer without reasoning blocks and code fences."""
    bare = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return stripped(F.regexp_replace(F.regexp_replace(stripped(bare), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def salvaged_json(text: Column) -> Column:
    """The JSON object of an answer, as text: all of it, or what stands from the first to the last brace; null if neither parses."""
    bare = without_thoughts(text)
    cut = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    whole = F.when(F.try_parse_json(bare).isNotNull(), bare)
    return F.coalesce(whole, F.when((cut != "") & F.try_parse_json(cut).isNotNull(), cut))


def not_placeholder(text: Column, strict: bool = True) -> Column:
    """Null for a template's placeholder. strict: `[Name.Part]` alone; else any bracketed or braced value."""
    return F.when(~text.rlike(r"^\[[\w.]+\]$" if strict else r"^(\[.*\]|\{.*\}|\{\{.*\}\})$"), text)


def zoom_lines(text: Column) -> Column:
    """Lines of a second look's text; where there are three or fewer, literal line ends count too."""
    lines = F.split(text, "\n")
    return F.when(F.size(lines) <= 3, F.split(F.replace(text, F.lit("\\n"), F.lit("\n")), "\n")).otherwise(lines)


def joined_pages(pages: Column, zoom: Column) -> Column:
    """Pages (structs of page and text) below their marks, and the text of the second look below its own."""
    marked = F.transform(pages, lambda p: F.concat(F.lit("--- PAGE "), p["page"].cast("string"), F.lit(" ---\n"), F.coalesce(p["text"], F.lit(""))))
    return F.concat_ws("\n", F.array_join(marked, "\n"), F.when(F.coalesce(zoom, F.lit("")) != "", F.concat(F.lit("--- ZOOM TEXT ---\n"), zoom)))


#: Letters with marks, from the tables of Unicode, and what they are without; đ has no mark but a stroke.
_MARKED = "".join(c for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]) if len(unicodedata.normalize("NFD", c)) > 1)


def without_diacritics(text: Column, stroke: bool = True) -> Column:
    """Letters without marks; with `stroke` đ is d."""
    bare = "".join(unicodedata.normalize("NFD", c)[0] for c in _MARKED)
    loose = F.regexp_replace(F.translate(text, _MARKED, bare), r"\p{Mn}", "")
    return F.translate(loose, "đĐ", "dD") if stroke else loose


def corrected(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Ordered literal replacements."""
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, text)


def char_jaccard(a: Column, b: Column) -> Column:
    """Similarity of the sets of characters, case folded; 0 if a text is empty."""
    sets = [F.array_distinct(F.filter(F.split(F.lower(x), ""), lambda c: c != "")) for x in (a, b)]
    return F.when((a == "") | (b == "") | a.isNull() | b.isNull(), 0.0).otherwise(F.size(F.array_intersect(*sets)) / F.size(F.array_union(*sets)))


def phone(text: Column) -> Column:
    """Digits of the number behind a phone label, fax left out; null under eight digits."""
    raw = found(text, r"(?iu)(?:Điện thoại|Tel)\s*[:\-]?\s*([\d.\s()\-]{8,})")
    digits = F.regexp_replace(raw, r"\D", "")
    return F.when(F.length(digits) >= 8, digits)


def email(text: Column) -> Column:
    return found(text, r"(?U)([\w.\-]+@[\w.\-]+\.\w+)")


def split_serial(code: Column) -> tuple[Column, Column]:
    """(serial, form) of a combined code: the digits in front, and the rest from a letter on; other codes are a serial."""
    parts = r"^(\d+)([A-Za-z].*)$"
    return F.coalesce(found(stripped(code), parts, 1), none_if_empty(stripped(code))), found(stripped(code), parts, 2)


def base64_payload(text: Column) -> Column:
    """Bytes of a base64 text or data URL; null if they can't be decoded."""
    return F.try_to_binary(F.when(text.contains(","), F.regexp_replace(text, r"^[^,]*,", "")).otherwise(text), F.lit("base64"))
