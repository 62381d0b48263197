"""Dates as documents write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import found, stripped


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def parse_document_date(text: Column) -> Column:
    """Day first, month first if that is no date, then the Vietnamese long form; null if none is a date."""
    numeric, spelled = r"(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})", r"(?iU)ngày\s*(\d{1,2})\s*tháng\s*(\d{1,2})\s*năm\s*(\d{4})"
    one, two, year = (found(text, numeric, k) for k in (1, 2, 3))
    return F.coalesce(_date(year, two, one), _date(year, one, two), _date(*(found(text, spelled, k) for k in (3, 2, 1))))


def parse_model_date(text: Column) -> Column:
    """ISO, then dd/MM/yyyy, MM/dd/yyyy and dd-MM-yyyy, over the whole text."""
    t = stripped(text)
    parts = lambda p, order: _date(*(found(t, p, k) for k in order))
    slash, dash = r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{1,2})-(\d{1,2})-(\d{4})$"
    return F.coalesce(parts(r"^(\d{4})-(\d{1,2})-(\d{1,2})$", (1, 2, 3)), parts(slash, (3, 2, 1)), parts(slash, (3, 1, 2)), parts(dash, (3, 2, 1)))


def iso_to_slashes(text: Column) -> Column:
    """2024-05-06 as 06/05/2024; other texts stay."""
    return F.regexp_replace(text, r"^(\d{4})-(\d+)-(\d+)$", "$3/$2/$1")
