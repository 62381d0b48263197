"""Whether two readers' values of a field say the same: a comparator for each field, as column expressions.

A comparator is a row of a table: how the value of the first reader and that of the second are brought to one form, and which
likenesses, beside equality, count. Two results are joined once by their keys; what spans two fields, the swap of serial and form, is told before
the row is laid out by field.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Form = Callable[[Column], Column]
Like = Callable[[Column, Column], Column]

# Labels that stand before a name, what follows a way of payment by mistake, misread words and their right form.
NAME_LABELS = r"^(?:Ký bởi:|Đơn vị bán hàng.*?:|Đơn vị mua hàng.*?:|Người ký:|Đơn vị bán hàng \(Seller\):|Tên đơn vị:)\s*"
PAYMENT_NOISE = r"\s*(?:Tỷ giá|\.{3,}|Mã số thuế).*$"
TITLE_NOTE = r"\s*\(VAT\s+INVOICE\)"
STREETS = [("Nguy ", "Ngụy "), ("Nguyễn Như Kinh", "Ngụy Như Kon")]
TITLES = [("HỌC ĐƠN", "HÓA ĐƠN"), ("HÒA ĐƠN", "HÓA ĐƠN")]


def as_is(x: Column) -> Column:
    return x


def right(pairs: list[tuple[str, str]]) -> Form:
    return lambda x: reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, x)


def without(pattern: str) -> Form:
    return lambda x: F.trim(F.regexp_replace(x, pattern, ""))


def spoken(x: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(x, r"[./,*\s]+", " ")))


def digits(x: Column) -> Column:
    return F.rtrim(F.regexp_replace(x, r"[\s.\-]+", ""))


def base(x: Column) -> Column:
    return F.substring_index(x, "/", 1)


def equal(a: Column, b: Column) -> Column:
    return a == b


def within(a: Column, b: Column) -> Column:
    """One holds the other."""
    return a.contains(b) | b.contains(a)


def begins(n: int, fold: bool = False) -> Like:
    """The first n characters are the same."""
    head = lambda x: F.lower(F.substring(x, 1, n)) if fold else F.substring(x, 1, n)
    return lambda a, b: head(a) == head(b)


def goes_on(n: int) -> Like:
    """One begins with the first n characters of the other."""
    return lambda a, b: a.startswith(F.substring(b, 1, n)) | b.startswith(F.substring(a, 1, n))


def local(a: Column, b: Column) -> Column:
    """Telephone numbers of which only one has the country's code for the leading zero."""
    home = lambda x, y: F.when(x.startswith("84") & ~y.startswith("84"), F.concat(F.lit("0"), F.substr(x, F.lit(3)))).otherwise(x)
    return home(a, b) == home(b, a)


def size(a: Column, b: Column) -> Column:
    """Amounts that differ in sign at most, as those of an adjustment do."""
    return F.abs(a.try_cast("double")) == F.abs(b.try_cast("double"))


def unread(a: Column, b: Column) -> Column:
    """The first reader's rate of nothing, which stands for none read."""
    return (a == "0%") & (b != "0%")


@dataclass(frozen=True)
class Comparator:
    like: tuple[Like, ...] = ()
    first: Form = as_is
    second: Form = as_is


_NAME = Comparator((equal, within, begins(25, fold=True)), without(NAME_LABELS))
_PLACE = Comparator((begins(25), within), right(STREETS))
_PHONE, _BANK, _AMOUNT = Comparator((local,), digits, digits), Comparator((within,)), Comparator((size,))
#: Fields without a row are the same if they are equal, as texts or as numbers.
COMPARATORS = {
    "invoiceTotalInWord": Comparator((equal, goes_on(40)), spoken, spoken),
    "sellerName": _NAME, "buyerName": _NAME, "sellerAddress": _PLACE, "buyerAddress": _PLACE, "sellerPhoneNumber": _PHONE, "buyerPhoneNumber": _PHONE, "sellerBank": _BANK, "buyerBank": _BANK,
    "paymentMethod": Comparator((within,), lambda x: without(PAYMENT_NOISE)(F.btrim(x, F.lit("| ")))),
    "invoiceName": Comparator((within,), lambda x: right(TITLES)(without(TITLE_NOTE)(F.ltrim(x, F.lit("n# ")))), lambda x: right(TITLES[1:])(without(TITLE_NOTE)(x))),
    "taxPercent": Comparator((unread,)), "preTaxPrice": _AMOUNT, "taxAmount": _AMOUNT, "totalAmount": _AMOUNT,
    "invoiceFormNo": Comparator((equal,), base, base),
}
#: Fields whose values one reader may have taken for each other's.
SWAPPED = ("invoiceSerial", "invoiceFormNo")


def same(field: str, a: Column, b: Column) -> Column:
    """Whether two values of the field, neither null, say the same."""
    a, b = F.trim(a), F.trim(b)
    told = (a == b) | F.coalesce(a.try_cast("double") == b.try_cast("double"), F.lit(False))
    if found := COMPARATORS.get(field):
        x, y = found.first(a), found.second(b)
        told = reduce(lambda c, like: c | F.coalesce(like(x, y), F.lit(False)), found.like, told)
    return told


def compared(left: DataFrame, right_: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, field, a, b, status) by each field's comparator: match, mismatch, only_left, only_right; without those that both lack."""
    struct = lambda df, name: df.select(*keys, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(name))
    both = struct(left, "__a").join(struct(right_, "__b"), keys, "full")
    a, b = (lambda f: F.col(f"__a.`{f}`")), (lambda f: F.col(f"__b.`{f}`"))
    swap = F.lit(False)
    if set(SWAPPED) <= set(fields):
        one, two = SWAPPED
        filled = reduce(lambda c, x: c & (F.coalesce(x, F.lit("")) != ""), [a(one), a(two), b(one), b(two)], F.lit(True))
        swap = filled & (a(one) == b(two)) & (a(two) == b(one))

    def status(f: str) -> Column:
        alike = same(f, a(f), b(f)) | (swap if f in SWAPPED else F.lit(False))
        return F.when(a(f).isNull(), "only_right").when(b(f).isNull(), "only_left").when(alike, "match").otherwise("mismatch")

    rows = F.array(*[F.struct(F.lit(f).alias("field"), a(f).alias("a"), b(f).alias("b"), status(f).alias("status")) for f in fields])
    return both.select(*keys, F.inline(rows)).where("a IS NOT NULL OR b IS NOT NULL")
