"""Shared helpers of the text operators: table access, word splitting, lineage cuts, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.lineage import cut

__all__ = ["BROADCAST_BYTES", "checked_broadcast", "cut", "fewer", "small_cut", "split_words", "spread_join", "table", "word_count"]

#: Rows times bytes that a broadcast side may have; larger sides are joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: What stands between words ``[^\x20\x09-\x0D]+``.
_SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fewer(df: DataFrame, rows: int, per_task: int = 50_000) -> DataFrame:
    """``df``, which has ``rows`` rows, in no more partitions than one per ``per_task`` rows: small tables
    that go through many rounds leave few files behind; large ones keep their partitions."""
    return df.coalesce(max(1, -(-rows // per_task)))


def small_cut(df: DataFrame, per_task: int = 50_000) -> DataFrame:
    """``cut``, then ``fewer`` by the counted rows."""
    df = cut(df)
    return fewer(df, df.count(), per_task)


def checked_broadcast(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (already cut) with a broadcast hint if its counted size is within ``limit``; else unchanged,
    so that the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df.hint("merge")


def split_words(text: Column, between: str) -> Column:
    """The pieces of a text around matches of ``between``, without empty ones; none for null.  Splitting at
    the few characters between words is several times faster than matching the words."""
    return F.coalesce(F.array_remove(F.split(text, between), ""), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; 0 for null."""
    return F.size(split_words(text, _SPACES)).cast("long")


def spread_join(rows: DataFrame, facts: DataFrame, on: str | list[str], hot: int = 500) -> DataFrame:
    """``rows`` joined to ``facts`` (cut), which has one row for each ``on`` and in ``n`` about how many rows meet it.

    The facts of a key that more than ``hot`` rows meet are laid out in copies of their own, one for each
    ``hot`` rows, and the key's rows are dealt over them, so that no task gathers the rows of one key.  Only
    the hot keys are told to the tasks, by a checked broadcast.
    """
    on = [on] if isinstance(on, str) else on
    copies = F.ceil(F.col("n") / hot)
    most = cut(facts.where(F.col("n") > hot).select(*on, copies.alias("__copies")))
    if most.isEmpty():
        return rows.join(facts, on)
    # any copy will do for a row
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("__copies")), F.lit(0).cast("long"))
    dealt = rows.join(checked_broadcast(most, 32), on, "left").withColumn("__salt", salt).drop("__copies")
    laid = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    return dealt.join(laid, [*on, "__salt"]).drop("__salt")
