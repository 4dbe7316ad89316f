"""Corpus pipeline: five stages from raw documents to shards.

Every stage works on all rows that its predecessor kept and is called as (spark, docs, sf_dir).  All but
the last return the columns of ``documents``.  Stages decide by row, not by doc_id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import checked_broadcast, cut, table
from millrace.llm.decontaminate import decontaminate
from millrace.llm.mixing import mix_sources
from millrace.llm.ngram_join import ngram_jaccard_join
from millrace.llm.quality_rules import fit_rules, keep_passing
from millrace.llm.sharding import assign_shards


_ROW = "__row"


def _named(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with a number for each row by its values in ``columns``, nulls included: equal rows share
    it, rows that share a doc_id, or have none, are told apart."""
    return docs.withColumn(_ROW, F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))]))


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``docs``, which are named, whose number is not among ``keys``."""
    return docs.join(checked_broadcast(cut(keys.select(_ROW).distinct()), 16), _ROW, "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the fixed rules, or the trees fitted on the labels, go.

    Null and empty texts fail; very long ones are judged whole; repeated rows are judged alike.  Without
    labels of these documents only the fixed rules hold.  An empty table stays empty.
    """
    return keep_passing(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id, one without
    doc_id only if no member has any, ties by a hash.

    Five-word shingles, similarity 0.8.  Of rows with equal doc_id (or none) and equal text one stays;
    different texts under one doc_id, or under none, are documents of their own.  Null and empty texts
    resemble nothing, so they stay.  An empty table stays empty.
    """
    named = _named(docs, "doc_id", "text")
    groups = cut(ngram_jaccard_join(named, key=_ROW, n=5, percent=80).select(_ROW, "component_id"))
    sizes = groups.groupBy(_ROW).agg(F.first("component_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    ids = named.select(_ROW, "doc_id").distinct()
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", _ROW)).getField(_ROW)
    winners = sizes.join(ids, _ROW).groupBy("component_id").agg(best.alias(_ROW)).select(_ROW)
    kept = _without(named, groups.join(winners, _ROW, "left_anti"))
    again = cut(sizes.where("n > 1").select(_ROW))
    if again.isEmpty():
        return kept.select(docs.columns)
    one = kept.join(checked_broadcast(again, 16), _ROW, "left_semi").dropDuplicates([_ROW]).select(named.columns)
    return _without(kept, again).union(one).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go, those without doc_id too.

    Rows are judged by their text, however often they repeat; null and empty texts stay.  An empty table, or
    an empty benchmark, changes nothing.
    """
    named = _named(docs, "doc_id", "text")
    return _without(named, decontaminate(named, table(spark, sf_dir, "benchmark"), key=_ROW).where("contaminated")).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents leave as often as the mix takes them: not at all, once or twice.

    The texts of a source weigh the same.  Repeated rows (equal doc_id, text and source) are numbered where
    the mix takes some of them more often.  Null and empty texts have no words, and their number is left to
    chance.  An empty table stays empty.
    """
    named = _named(docs, "doc_id", "text", "source")
    drawn = mix_sources(named, key=_ROW).groupBy(_ROW)
    drawn = drawn.agg(F.min("copies").alias("__least"), F.max("copies").alias("__most"), F.sum("copies").alias("__all"), F.count(F.lit(1)).alias("__n"))
    # copies of equal rows differ by one at most
    more = (F.col("__all") - F.col("__n") * F.col("__least")).alias("__more")
    drawn = cut(drawn.where("__most > 0").select(_ROW, "__least", "__most", more))
    taken = named.join(checked_broadcast(cut(drawn.where("__least = __most")), 32), _ROW).withColumn("__times", F.col("__least"))
    split = cut(drawn.where("__least < __most"))
    if not split.isEmpty():
        some = named.join(checked_broadcast(split, 32), _ROW)
        nth = F.row_number().over(Window.partitionBy(_ROW).orderBy(F.xxhash64(*docs.columns)))
        taken = taken.union(some.withColumn("__times", F.col("__least") + (nth <= F.col("__more")).cast("int")).where("__times > 0"))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mix gets its shard and its place there; null texts and doc_ids, and copies, too.
    An empty table gives none."""
    return assign_shards(docs, shards=8)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: The trees of the first stage cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; what each keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
