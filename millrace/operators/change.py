"""INSERT, UPDATE, DELETE and schema changes as DataFrame transformations.

Each takes a table's rows and returns its rows after the change, to be written as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lineage import cut


class DuplicateKey(ValueError):
    """Error 1062."""

    code = 1062


def duplicate_keys(table: DataFrame, added: DataFrame, key: list[str]) -> DataFrame:
    """Keys of ``added`` that occur there twice or in ``table`` already; a key with a NULL repeats freely."""
    new = added.select(key).na.drop()
    twice = new.groupBy(key).count().where("count > 1").select(key)
    return twice.union(new.join(table.select(key), key, "left_semi")).distinct()


def insert(table: DataFrame, added: DataFrame, keys: list[list[str]] | None = None, auto: str | None = None) -> DataFrame:
    """``table`` with the rows of ``added`` (its columns by name, missing ones NULL).

    ``auto``: a column in which NULL and 0 are replaced by the numbers after the largest one so far.
    ``keys``: unique keys; a violation raises DuplicateKey.  The rows are checkpointed once they are
    numbered, so that what is checked is what is added, whatever is computed again.
    """
    rows = added.select(*[(added[c] if c in added.columns else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    if auto:
        rows = cut(number(rows, auto, table.agg(F.coalesce(F.max(auto), F.lit(0))).first()[0]))
    for key in keys or []:
        if not duplicate_keys(table, rows, key).isEmpty():
            raise DuplicateKey(f"Duplicate entry for key {', '.join(key)}")
    return table.unionByName(rows)


def number(rows: DataFrame, column: str, after: int) -> DataFrame:
    """Fills NULL and 0 in ``column`` with ``after`` + 1, + 2, and so on.

    Each row's partition and place are checkpointed first and read by all that follows.  Rows are numbered
    inside their partition and shifted by the partitions before, so no task holds them all.
    """
    open_ = F.coalesce(F.col(column), F.lit(0)) == 0
    placed = cut(rows.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    per = placed.where(open_).groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))  # one row a partition
    inside = Window.partitionBy("__part").orderBy(~open_, "__at")
    placed = placed.join(F.broadcast(base), "__part", "left").withColumn("__nth", F.row_number().over(inside))
    value = F.when(open_, F.lit(after) + F.col("__base") + F.col("__nth")).otherwise(F.col(column))
    return placed.withColumn(column, value.cast(rows.schema[column].dataType)).select(rows.columns)


def update(table: DataFrame, assign: dict[str, Column], where: Column | None = None) -> DataFrame:
    """All new values are computed from the old row; rows where ``where`` is not true stay."""
    hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    new = {c: F.when(hit, v).otherwise(F.col(c)).cast(table.schema[c].dataType) for c, v in assign.items()}
    return table.select(*[new[c].alias(c) if c in new else F.col(c) for c in table.columns])


def update_join(table: DataFrame, other: DataFrame, key: list[str], assign: dict[str, Column]) -> DataFrame:
    """UPDATE of ``table`` joined to ``other`` on ``key``; a row with several partners is changed once, by the
    partner that is smallest in ``other``'s columns from left to right (NULL first).
    ``assign`` may use columns of ``other``, which come with the prefix ``o_``."""
    least = F.min(F.struct(*[F.col(c).alias(f"o_{c}") for c in other.columns])).alias("__o")
    picked = other.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(least)
    joined = table.join(picked, [F.col(k) == F.col(f"__{k}") for k in key], "left").select(*table.columns, "__o.*", F.col("__o").isNotNull().alias("__hit"))
    return update(joined, assign, F.col("__hit")).select(table.columns)


def delete(table: DataFrame, where: Column | None = None) -> DataFrame:
    return truncate(table) if where is None else table.where(~F.coalesce(where, F.lit(False)))


def delete_join(table: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    """Rows without a partner in ``other``."""
    return table.join(other.select(key), key, "left_anti")


def truncate(table: DataFrame) -> DataFrame:
    """No rows, the same columns; the scan is dropped from the plan."""
    return table.where(F.lit(False))


def add_column(table: DataFrame, name: str, kind: str, after: str | None = None, first: bool = False) -> DataFrame:
    """Old rows read NULL."""
    at = 0 if first else (table.columns.index(after) + 1 if after else len(table.columns))
    order = [*table.columns[:at], name, *table.columns[at:]]
    return table.withColumn(name, F.lit(None).cast(kind)).select(order)


def drop_column(table: DataFrame, name: str) -> DataFrame:
    return table.drop(name)
