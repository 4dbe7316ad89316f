"""Scan, projection, selection, joins, subquery predicates, grouping, order, limits and unions.

Each operator returns a plan; Catalyst prunes columns, pushes filters into the Parquet scan and picks
join and aggregate strategies.  Nothing here runs a job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

JOIN_KINDS = ("inner", "left", "right", "cross")
#: Consecutive rows that ``join_lists`` gathers by key at once, as bits, and rows of a list at most.
BLOCK_BITS = 16
LIST_ROWS = 1024


def scan(spark: SparkSession, path: str, columns: list[str] | None = None, *conditions: Column) -> DataFrame:
    df = spark.read.parquet(path)
    for condition in conditions:
        df = df.where(condition)
    return df.select(*columns) if columns else df


def dual(spark: SparkSession, **columns: Column) -> DataFrame:
    """SELECT without FROM: one row."""
    return spark.range(1).select(*[c.alias(name) for name, c in columns.items()])


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def project(df: DataFrame, **columns: Column | str) -> DataFrame:
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def select(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which every condition is true; NULL drops the row."""
    return df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))


def join(left: DataFrame, right: DataFrame, on: Column | None = None, kind: str = "inner") -> DataFrame:
    """``on`` may be any condition; equalities in it become keys, which NULL never matches."""
    if kind not in JOIN_KINDS:
        raise ValueError(f"unknown join kind {kind!r}")
    if kind == "cross" or on is None:
        joined = left.crossJoin(right)
        return joined if on is None else joined.where(on)
    return left.join(right, on, kind)


def _lists(df: DataFrame, key: str, side: str) -> DataFrame:
    """The rows of each key in lists, named ``side``; a side of one column is a list of its values."""
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)
    rows = df.select(F.col(key).alias(f"{side}_key"), block.alias("__block"), F.struct(*[c for c in df.columns if c != key]).alias(side))
    lists = rows.groupBy(f"{side}_key", "__block").agg(F.collect_list(side).alias(side))
    fields = rows.schema[side].dataType.names
    if len(fields) == 1:
        lists = lists.withColumn(side, F.col(side)[fields[0]])
    first = F.explode(F.sequence(F.lit(1), F.size(side), F.lit(LIST_ROWS))).alias("__first")
    return lists.select(f"{side}_key", side, first).select(f"{side}_key", F.slice(side, F.col("__first"), LIST_ROWS).alias(side))


def join_lists(left: DataFrame, right: DataFrame, left_key: str, right_key: str, kind: str = "inner") -> DataFrame:
    """The columns but the keys of ``left`` and ``right`` (named differently) where the keys are equal, which
    NULL never is; ``kind`` is inner or left.

    For few keys that many rows of both sides share, so that there are far more pairs than rows.  Rows are
    gathered in bounded lists by key, lists are paired, and the pairs of lists are dealt over all tasks, each
    of which writes out its pairs of rows one by one.  So the pairs of rows of a key are made by many
    tasks; only its lists meet in one, unless Spark broadcasts them, and spill there if they are many.  Lists are cut by the order of rows, which has to be the same when
    a task is repeated, as it is in a scan.
    """
    if kind not in ("inner", "left"):
        raise ValueError(f"unknown join kind {kind!r}")
    sides = [(left, left_key, "__left"), (right, right_key, "__right")]
    a, b = (_lists(*side) for side in sides)
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    out = a.join(b, F.col("__left_key") == F.col("__right_key"), kind).select("__left", "__right").repartition(tasks)
    # a generator's rows are held until its stage is through with the row they come from: the coalesce, of as
    # many partitions as there are, ends the stage, so that the next one holds the rows of one list, not of two
    out = out.select(F.explode("__left").alias("__left"), "__right").coalesce(tasks)
    out = out.select("__left", (F.explode_outer if kind == "left" else F.explode)("__right").alias("__right"))
    columns = []
    for df, key, side in sides:
        names = [c for c in df.columns if c != key]
        columns += [F.col(side).alias(names[0])] if len(names) == 1 else [F.col(side)[c].alias(c) for c in names]
    return out.select(*columns)


def where_in(df: DataFrame, column: str, query: DataFrame) -> DataFrame:
    """column IN (query); ``query`` has one column."""
    q = query.toDF("__in")
    return df.join(q, df[column] == q["__in"], "left_semi")


def where_not_in(df: DataFrame, column: str, query: DataFrame) -> DataFrame:
    """column NOT IN (query), with SQL's rule: a NULL in the query lets no row pass, a NULL in the column
    passes only if the query is empty.

    One anti join on the key plus two facts about the query, an aggregate of one row.
    """
    q = query.toDF("__in")
    facts = q.agg(F.count(F.lit(1)).alias("__n"), F.count("__in").alias("__known"))
    kept = df.join(q.where(F.col("__in").isNotNull()), df[column] == F.col("__in"), "left_anti")
    # facts is one row by construction
    passed = kept.crossJoin(F.broadcast(facts)).where((F.col("__n") == 0) | ((F.col("__n") == F.col("__known")) & kept[column].isNotNull()))
    return passed.select(df.columns)


def where_exists(df: DataFrame, query: DataFrame, on: Column | None = None, negate: bool = False) -> DataFrame:
    """[NOT] EXISTS (query); without ``on`` it is uncorrelated and the first row decides."""
    if on is not None:
        return df.join(query, on, "left_anti" if negate else "left_semi")
    one = query.limit(1).agg(F.count(F.lit(1)).alias("__n"))
    found = df.crossJoin(F.broadcast(one)).where((F.col("__n") == 0) if negate else (F.col("__n") > 0))
    return found.select(df.columns)


def with_scalar(df: DataFrame, name: str, query: DataFrame) -> DataFrame:
    """Adds the value of a scalar subquery: NULL for no row, an error for more than one."""
    q = query.toDF("__v").limit(2).agg(F.count(F.lit(1)).alias("__n"), F.first("__v").alias("__v"))
    checked = F.when(F.col("__n") <= 1, F.col("__v")).otherwise(F.raise_error(F.lit("subquery returns more than one row")))
    return df.crossJoin(F.broadcast(q.select(checked.alias(name))))


def aggregate(df: DataFrame, keys: dict[str, Column | str], measures: dict[str, Column], having: Column | None = None) -> DataFrame:
    """Groups by expressions; without keys one row even for no input.  NULL is a group."""
    aggs = [m.alias(name) for name, m in measures.items()]
    if keys:
        out = df.groupBy(*[(F.col(k) if isinstance(k, str) else k).alias(name) for name, k in keys.items()]).agg(*aggs)
    else:
        out = df.agg(*aggs)
    return out if having is None else out.where(having)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def sort(df: DataFrame, *order: Column | str) -> DataFrame:
    """NULL is smallest: first when ascending, last when descending."""
    return df.orderBy(*order)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    return (df.offset(offset) if offset else df).limit(n)


def top_k(df: DataFrame, n: int, *order: Column | str, offset: int = 0) -> DataFrame:
    """Sort and limit in one: each task keeps n + offset rows."""
    return limit(df.orderBy(*order), n, offset)


def union(first: DataFrame, *others: DataFrame, all_: bool = False) -> DataFrame:
    """By position, names from the first; without ``all_`` rows are distinct and NULLs equal."""
    if any(len(o.columns) != len(first.columns) for o in others):
        raise ValueError("the used SELECT statements have a different number of columns")
    out = reduce(DataFrame.union, others, first)
    return out if all_ else out.distinct()
