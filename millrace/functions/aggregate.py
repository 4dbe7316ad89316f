"""Aggregate functions of the dialect; all are combined on the map side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_all() -> Column:
    return F.count(F.lit(1))


def count(c: Column, distinct: bool = False) -> Column:
    return F.count_distinct(c) if distinct else F.count(c)


def _exact(c: Column, scale: int | None, digits: int) -> Column:
    """Without a scale: 28 digits before the point, so sums of any BIGINT fit, and 10 behind it."""
    return c.cast("decimal(38,10)" if scale is None else f"decimal({digits},{scale})")


def total(c: Column, scale: int | None = None, distinct: bool = False) -> Column:
    """SUM as an exact DECIMAL, of ``scale`` or of 10 places; NULL over no values."""
    d = _exact(c, scale, 28)
    return F.sum_distinct(d) if distinct else F.sum(d)


def average(c: Column, scale: int | None = None, distinct: bool = False) -> Column:
    """AVG as DECIMAL rounded half up to four places; NULL over no values."""
    d = _exact(c, scale, 18)
    n = F.count_distinct(d) if distinct else F.count(d)
    s = F.sum_distinct(d) if distinct else F.sum(d)
    whole = s if scale is None else s.cast(f"decimal(26,{scale})")
    return F.round(F.try_divide(whole, n.cast("decimal(11,0)")), 4)


def minimum(c: Column) -> Column:
    return F.min(c)


def maximum(c: Column) -> Column:
    return F.max(c)


def group_concat(c: Column, distinct: bool = False) -> Column:
    """Values joined by ',' in ascending text order; NULL over no values.

    The text of a group is one value, so its size is that of the result itself.
    """
    text = c.cast("string")
    values = F.collect_set(text) if distinct else F.collect_list(text)
    return F.when(F.count(text) > 0, F.array_join(F.array_sort(values), ","))
