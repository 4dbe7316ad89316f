"""Scalar functions and operators of the dialect as Column expressions.

Where the dialect differs from Spark's ANSI defaults: division by zero gives NULL, arithmetic on
anything but integers is double, LIKE ignores case, casts never fail, SUBSTRING at 0 is empty.
All of it stays inside code generation.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

def lit(value: object) -> Column:
    """A literal: integers are BIGINT, fractions DOUBLE."""
    if isinstance(value, bool):
        return F.lit(value)
    if isinstance(value, int):
        return F.lit(value).cast("long")
    return F.lit(value)


# truth and choice


def truth(c: Column, kind: str) -> Column:
    """Whether a value of type name ``kind`` counts as true: numbers unless 0, strings unless '' or '0',
    times always."""
    if kind == "boolean":
        return c
    if kind == "string":
        return (c != "") & (c != "0")
    if kind.startswith(("date", "timestamp", "binary")):
        return F.when(c.isNotNull(), F.lit(True))
    return c != 0


def if_(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def ifnull(a: Column, b: Column) -> Column:
    return F.coalesce(a, b)


def nullif(a: Column, b: Column) -> Column:
    return F.nullif(a, b)


def coalesce(*values: Column) -> Column:
    return F.coalesce(*values)


def case_when(branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """Searched CASE: the first true condition's value."""
    out = F
    for condition, value in branches:
        out = out.when(condition, value)
    return out if otherwise is None else out.otherwise(otherwise)


def case_value(of: Column, branches: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """Simple CASE: the first equal value's result; NULL equals nothing."""
    return case_when([(of == match, value) for match, value in branches], otherwise)


# comparison


def like(c: Column, pattern: str) -> Column:
    return c.ilike(pattern)


def between(c: Column, low: Column | float | str | datetime.datetime, high: Column | float | str | datetime.datetime) -> Column:
    """Inclusive; NULL if any part is NULL.

    Bounds that are plain values are known not to be NULL: two comparisons, which reach the scan.
    """
    if not isinstance(low, Column) and not isinstance(high, Column) and low is not None and high is not None:
        return (c >= low) & (c <= high)
    low, high = (x if isinstance(x, Column) else F.lit(x) for x in (low, high))
    whole = c.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.when(whole, (c >= low) & (c <= high))


def in_list(c: Column, values: list) -> Column:
    """Found: true; not found with a NULL in the list: NULL."""
    return c.isin(*values)


def text_of_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


# arithmetic


def add_int(a: Column, b: Column) -> Column:
    """64-bit; overflow is an error."""
    return a.cast("long") + b.cast("long")


def subtract_int(a: Column, b: Column) -> Column:
    return a.cast("long") - b.cast("long")


def multiply_int(a: Column, b: Column) -> Column:
    return a.cast("long") * b.cast("long")


def add(a: Column, b: Column) -> Column:
    return a.cast("double") + b.cast("double")


def subtract(a: Column, b: Column) -> Column:
    return a.cast("double") - b.cast("double")


def multiply(a: Column, b: Column) -> Column:
    return a.cast("double") * b.cast("double")


def divide(a: Column, b: Column) -> Column:
    """Always double; NULL for divisor 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def modulo(a: Column, b: Column) -> Column:
    """Remainder of the operands' own type; NULL for divisor 0."""
    return F.try_mod(a, b)


def int_divide(a: Column, b: Column) -> Column:
    """Both sides cut to whole numbers first; NULL for divisor 0."""
    return F.call_function("div", a.cast("long"), F.nullif(b.cast("long"), F.lit(0).cast("long")))


def _wide(c: Column, kind: str) -> Column:
    """Whole numbers in a type that also holds the opposite of the smallest one: for BIGINT that is DECIMAL;
    anything else as DOUBLE."""
    if kind == "bigint":
        return c.cast("decimal(20,0)")
    return c.cast("long") if _family(kind) == "bigint" else cast_double(c, kind)


def negate(a: Column, kind: str = "bigint") -> Column:
    """Unary minus of a value of type name ``kind``; never an error."""
    return -_wide(a, kind)


# strings


def concat(*values: Column) -> Column:
    return F.concat(*[v.cast("string") for v in values])


def length(c: Column) -> Column:
    """In characters."""
    return F.char_length(c.cast("string")).cast("long")


def upper(c: Column) -> Column:
    return F.upper(c)


def lower(c: Column) -> Column:
    return F.lower(c)


def trim(c: Column) -> Column:
    """Takes characters up to U+0020 off both ends."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def substring(c: Column, position: Column | int, size: Column | int | None = None) -> Column:
    """1-based, negative from the end; '' for position 0, outside the text, or sizes below 1."""
    p = F.lit(position) if isinstance(position, int) else position
    n = F.char_length(c)
    start = F.when(p > 0, p).otherwise(n + p + 1)
    take = n if size is None else (F.lit(size) if isinstance(size, int) else size)
    inside = (p != 0) & (start >= 1) & (start <= n) & (take > 0)
    return F.when(c.isNotNull() & p.isNotNull(), F.when(inside, F.substring(c, start, take)).otherwise(""))


def replace(c: Column, old: Column, new: Column) -> Column:
    return F.replace(c, old, new)


def left(c: Column, n: Column) -> Column:
    return F.left(c, n)


def right(c: Column, n: Column) -> Column:
    return F.right(c, n)


# numbers


def absolute(c: Column, kind: str = "bigint") -> Column:
    """ABS of a value of type name ``kind``; never an error."""
    return F.abs(_wide(c, kind))


def ceil(c: Column) -> Column:
    return F.ceil(c.cast("double"))


def floor(c: Column) -> Column:
    return F.floor(c.cast("double"))


def round_(c: Column, scale: int = 0) -> Column:
    """Half away from zero; BIGINT without a scale, else DOUBLE."""
    out = F.round(c.cast("double"), scale)
    return out.cast("long") if scale == 0 else out


def mod(a: Column, b: Column) -> Column:
    """Of whole numbers; NULL for divisor 0."""
    return F.try_mod(a.cast("long"), b.cast("long"))


def power(a: Column, b: Column) -> Column:
    return F.pow(a.cast("double"), b.cast("double"))


def sqrt(c: Column) -> Column:
    """NULL below 0."""
    d = c.cast("double")
    return F.when(d >= 0, F.sqrt(d))


def rand() -> Column:
    return F.rand()


# time


def now() -> Column:
    return F.localtimestamp()


def curdate() -> Column:
    return F.current_date().cast("timestamp_ntz")


def year(c: Column) -> Column:
    return F.year(c).cast("long")


def month(c: Column) -> Column:
    return F.month(c).cast("long")


def day(c: Column) -> Column:
    return F.dayofmonth(c).cast("long")


# casts: never an error

_TIMES = ("date", "timestamp")
_WHOLE = ("tinyint", "smallint", "int", "bigint")
_MOST, _LEAST = (1 << 63) - 1, -(1 << 63)


def _or_zero(c: Column, kind: str) -> Column:
    return F.when(c.isNotNull(), F.coalesce(c.try_cast(kind), F.lit(0).cast(kind)))


def cast_int(c: Column, kind: str = "string") -> Column:
    """BIGINT of a value of type name ``kind``: text that is no whole number, and times, give 0; fractions
    are cut off, and end at the bounds of BIGINT."""
    if kind.startswith(_TIMES) or kind == "binary":
        return F.when(c.isNotNull(), F.lit(0).cast("long"))
    if kind in ("float", "double"):
        known = F.nanvl(c.cast("double"), F.lit(0.0))
        return F.when(c.isNotNull(), F.when(known >= float(_MOST), F.lit(_MOST)).when(known <= float(_LEAST), F.lit(_LEAST)).otherwise(_or_zero(known, "long")))
    return _or_zero(c, "long")


def cast_double(c: Column, kind: str = "string") -> Column:
    """DOUBLE; text that is no number, and times, give 0."""
    if kind.startswith(_TIMES) or kind == "binary":
        return F.when(c.isNotNull(), F.lit(0.0))
    return _or_zero(c, "double")


def cast_decimal(c: Column, precision: int = 10, scale: int = 0, kind: str = "string") -> Column:
    """DECIMAL; times, and text that is no number or has blanks around it, give NULL."""
    to = f"decimal({precision},{scale})"
    if kind.startswith(_TIMES) or kind == "binary":
        return F.lit(None).cast(to)
    if kind == "string":
        return F.when(~c.rlike(r"^[\x00-\x20]|[\x00-\x20]$"), c.try_cast(to))
    return c.try_cast(to)


def cast_datetime(c: Column, kind: str = "string") -> Column:
    """DATETIME; text but for ``yyyy-MM-dd HH:mm:ss``, with blanks around it at most, gives NULL, and so do
    numbers."""
    if kind.startswith(_TIMES):
        return c.cast("timestamp_ntz")
    plain = trim(c.cast("string"))
    return F.when(plain.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), plain.try_cast("timestamp_ntz"))


def cast_string(c: Column, kind: str = "string") -> Column:
    """Text of a value: times as ``yyyy-MM-dd HH:mm:ss``, booleans as 1 and 0, bytes as 0x and hex."""
    if kind.startswith(_TIMES):
        return text_of_time(c)
    if kind == "boolean":
        return c.cast("int").cast("string")
    return F.concat(F.lit("0x"), F.hex(c)) if kind == "binary" else c.cast("string")


# values of different types


def _family(kind: str) -> str:
    if kind in _WHOLE or kind == "boolean":
        return "bigint"
    if kind in ("float", "double"):
        return "double"
    if kind.startswith("decimal"):
        return "decimal"
    return "time" if kind.startswith(_TIMES) else kind


def common_kind(*kinds: str) -> str:
    """The type that CASE gives branches of several types: DECIMAL before DOUBLE before BIGINT among numbers,
    DATETIME among times, else text.  Untyped NULLs (void) do not count."""
    families = {_family(k) for k in kinds if k != "void"}
    if len(families) <= 1:
        return next(iter(families), "void")
    if families <= {"bigint", "double", "decimal"}:
        return "decimal" if "decimal" in families else "double"
    return "string"


def as_kind(c: Column, kind: str, common: str) -> Column:
    """A value of type ``kind`` as one of ``common``, as ``common_kind`` names it."""
    if common == "string":
        return cast_string(c, kind)
    return c.cast({"decimal": "decimal(38,10)", "time": "timestamp_ntz", "bigint": "bigint", "double": "double"}.get(common, common))


def comparable(a: Column, kind_a: str, b: Column, kind_b: str) -> tuple[Column, Column]:
    """Both sides as they are compared: numbers with numbers and times with times by value, bytes with
    bytes, anything else by its text."""
    common = common_kind(kind_a, kind_b)
    return as_kind(a, kind_a, common), as_kind(b, kind_b, common)


def case_mixed(branches: list[tuple[Column, Column, str]], otherwise: tuple[Column, str] | None = None) -> Column:
    """Searched CASE over (condition, value, type name of the value); the result has their common type."""
    common = common_kind(*[k for _, _, k in branches], *([otherwise[1]] if otherwise else []))
    last = as_kind(*otherwise, common) if otherwise else None
    return case_when([(condition, as_kind(value, kind, common)) for condition, value, kind in branches], last)
