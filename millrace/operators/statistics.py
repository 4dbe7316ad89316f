"""ANALYZE: row count, column statistics and equi-depth histograms, as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.lineage import cut


def column_statistics(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, n_rows, n_nulls, n_distinct, low, high), bounds as text; one pass, then one row a column."""
    columns = columns or table.columns
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(columns):
        aggs += [
            F.count(c).alias(f"known_{i}"),
            F.count_distinct(F.col(c)).alias(f"distinct_{i}"),
            F.min(c).cast("string").alias(f"low_{i}"),
            F.max(c).cast("string").alias(f"high_{i}"),
        ]
    one = table.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col("n_rows"),
                (F.col("n_rows") - F.col(f"known_{i}")).alias("n_nulls"),
                F.col(f"distinct_{i}").alias("n_distinct"),
                F.col(f"low_{i}").alias("low"),
                F.col(f"high_{i}").alias("high"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return one.select(F.inline(rows))


def histogram(table: DataFrame, column: str, buckets: int = 256) -> DataFrame:
    """(bucket, low, high, n, repeats, n_distinct) of about equal depth, for a column that can be ordered.

    Value by value, the bucket is that of the value's last row in order: rows are counted per value, and
    the running count comes from counts of value ranges (shuffled by range, summed per range), so no task
    orders the column.  ``repeats`` counts the rows of ``high``.  NULLs are left out.  Exact at every size.
    """
    values = table.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    placed = cut(values.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a partition
    base = placed.groupBy("part").agg(F.sum("n").alias("own")).select("part", F.coalesce(F.sum("own").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.col("base") + F.sum("n").over(inside)
    whole = table.agg(F.count(column).alias("whole"))
    ranked = placed.join(F.broadcast(base), "part").crossJoin(F.broadcast(whole))
    bucket = F.call_function("div", (rank - 1) * buckets, F.col("whole")).cast("int")
    ranked = ranked.select(bucket.alias("bucket"), "v", "n")
    return ranked.groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.sum("n").alias("n"), F.max_by("n", "v").alias("repeats"), F.count(F.lit(1)).alias("n_distinct"))
