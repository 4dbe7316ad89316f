"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checked_broadcast, cut, small_cut, word_count


def source_targets(sizes: DataFrame, pattern: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights follow ``pattern`` over sources in code-point order, null last.  Targets share ``share``
    times the whole size by weight; none exceeds ``cap`` times its source, and what is cut off goes to
    the others by weight until nothing is above.  The level where this ends is found directly: with
    sources in order of cap / weight, those below the level are full and the rest split what remains.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    # every window below runs over one row per source
    nth = F.pmod(F.row_number().over(order) - 1, F.lit(len(pattern))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(p)) for p in pattern]), nth + 1)
    s = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    first = Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns(
        {
            "left": F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("most").over(first), F.lit(0.0)),
            "heavy": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(first), F.lit(0.0)),
        }
    )
    s = s.withColumn("level", F.when(F.col("left") / F.col("heavy") <= F.col("ratio"), F.col("left") / F.col("heavy")))
    s = s.withColumn("level", F.first("level", ignorenulls=True).over(Window.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least("most", F.col("weight") * F.coalesce("level", F.lit(float("inf"))))
    return s.select("source", "source_size", target.alias("target"))


def clean_text_weight(text: Column) -> Column:
    """A weight from 0 to 1 for texts: the mean word length (10 characters at most count), lowered by the
    characters of ``#*$%&|<>`` a word; 1 for texts without words."""
    words = F.nullif(word_count(text), F.lit(0).cast("long")).cast("double")
    plain = F.char_length(F.translate(text, "#*$%&|<>", ""))
    return F.coalesce(F.least(F.char_length(text) / words, F.lit(10.0)) / 10 / (1 + (F.char_length(text) - plain) / words), F.lit(1.0))


def _of_source(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row a source (cut, so that it can be counted)."""
    named = checked_broadcast(facts, 64).withColumnRenamed("source", "__s")
    return rows.join(named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")


def _levels(rows: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(source, source_size, target, level): with min(level * w, cap) copies of each document a source has
    its target, to half a word.

    Starting from what would do without the cap, what capped documents lack is shared again among the
    others by weight, until nothing is missing.  Each round is one sum per source.
    """
    none = F.lit(0.0)
    tilted = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("w")).alias("open"))
    # a source that is wanted whole, cap times, is capped throughout
    full = F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)
    start = F.when(full, F.lit(float("inf"))).when(F.col("open") > 0, F.col("target") / F.col("open")).otherwise(none)
    levels = cut(_of_source(targets, cut(tilted)).select("source", "source_size", "target", start.alias("level")))
    while True:
        capped = F.col("level") * F.col("w") >= cap
        size = F.col("size").cast("double")
        sums = _of_source(rows, levels).groupBy("source").agg(
            F.sum(F.when(capped, size * cap).otherwise(none)).alias("full"), F.sum(F.when(capped, none).otherwise(size * F.col("w"))).alias("open")
        )
        now = cut(_of_source(levels, cut(sums)))
        missing = F.col("target") - F.col("full") - F.col("level") * F.col("open")
        again = (F.col("open") > 0) & (F.col("level") < float("inf")) & (missing > 0.5)
        if now.where(again).isEmpty():
            return levels
        levels = cut(now.select("source", "source_size", "target", F.when(again, (F.col("target") - F.col("full")) / F.col("open")).otherwise(F.col("level")).alias("level")))


def _draw(open_: DataFrame) -> DataFrame:
    """``open_`` with ``now``: whether a row is among the first ones in rank whose sizes add up to the
    source's room at most.

    Sums over (source, bucket) place every bucket, and only inside a bucket rows are ordered.
    """
    sums = open_.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most one row per source and bucket
    base = cut(sums.select(F.col("source").alias("s2"), F.col("bucket").alias("b2"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    r = open_.join(checked_broadcast(base, 64), F.col("source").eqNullSafe(F.col("s2")) & (F.col("bucket") == F.col("b2"))).drop("s2", "b2")
    inside = Window.partitionBy("source", "bucket").orderBy("rank", "draw", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return r.withColumn("now", F.col("base") + F.sum("size").over(inside) <= F.col("room")).drop("base")


def mix_sources(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: Column | None = None,
    pattern: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    buckets: int | None = None,
    seed: int = 17,
) -> DataFrame:
    """(key, size, source_size, target, taken, copies) for every row of ``docs``.

    A document's expected copies follow ``weight`` (a column of ``docs``; NULL and NaN count as 1, and all
    are brought into 1e-6 to 1e6; without it all of a source weigh the same) up to ``cap``, at the level
    where the source has its target (``_levels``).  Their whole part is certain.  The rest is an inclusion
    probability p, and documents are ranked by U / (1 - U) divided by p / (1 - p) with U from a hash of key,
    text and ``seed``: Pareto order sampling at the fixed size that the source still needs, counted in
    words.  In order of rank, ties by U and key, each document that still fits is drawn; so a source misses
    its target by less than its shortest document that was not drawn.

    Ranks are cut into ``buckets`` per source (unset: one per 20,000 rows, 64 at least); sums over buckets
    place every bucket, and only inside a bucket rows are ordered, so a source with most of the rows is
    spread over all tasks.

    ``size`` counts ``[^\\x20\\x09-\\x0D]+`` words (null and empty texts: 0; a very long text is one row like
    any other, and taken whole or not at all).  A null source is a source of its own, last in order.
    Repeated rows (same key and text) rank next to each other and are drawn one by one.  Null keys are
    keys.  Reruns agree.  Other columns of ``docs`` are not read; an empty table gives an empty result.
    """
    w = F.lit(1.0) if weight is None else F.greatest(F.least(F.coalesce(F.nanvl(weight.cast("double"), F.lit(1.0)), F.lit(1.0)), F.lit(1e6)), F.lit(1e-6))
    rows = docs.select(
        docs[key].alias("key"),
        word_count(docs[text]).alias("size"),
        docs[source].alias("source"),
        w.alias("w"),
        F.xxhash64(docs[key], docs[text], F.lit(seed)).alias("draw"),
    )
    rows = cut(rows)  # the texts are read once
    buckets = buckets or max(64, rows.count() // 20_000)
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    levels = _levels(rows, cut(source_targets(per, pattern, share, cap)), cap)
    r = _of_source(rows, levels)
    expected = F.least(F.col("level") * F.col("w"), F.lit(float(cap)))
    r = r.withColumn("whole", F.floor(expected)).withColumn("p", expected - F.col("whole"))
    sums = r.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("sure"), F.sum(F.when(F.col("p") > 0, F.col("size"))).alias("some"))
    facts = cut(_of_source(levels.select("source", "target"), cut(sums)).select("source", (F.col("target") - F.col("sure")).alias("room"), "some"))
    r = _of_source(r, facts)
    u = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    # Odds of the draw over odds of inclusion; put into 0..1 by way of the source's mean odds, which keeps
    # the order and spreads documents of about the same weight evenly.
    fair = F.least(F.greatest(F.try_divide("room", "some"), F.lit(1e-6)), F.lit(1 - 1e-6))
    q = (u / (1 - u)) * ((1 - F.col("p")) / F.col("p")) * (fair / (1 - fair))
    r = r.withColumn("rank", F.when(F.col("p") > 0, q / (1 + q)).otherwise(F.lit(1.0)))
    r = r.withColumn("bucket", F.least(F.floor(F.col("rank") * buckets), F.lit(buckets - 1)).cast("int"))
    r = cut(r.select("source", "key", "size", "source_size", "target", "whole", "p", "draw", "rank", "bucket", "room"))

    columns = ["key", "size", "source_size", "target", "whole"]
    fits = (F.col("p") > 0) & (F.col("size") <= F.col("room"))
    decided = [r.where(~fits).select(*columns, F.lit(False).alias("drawn"))]
    open_ = r.where(fits)
    while True:
        marked = small_cut(_draw(open_))
        decided.append(marked.where("now").select(*columns, F.lit(True).alias("drawn")))
        left = marked.where("NOT now").drop("now")
        # what is left of the room of the sources where anything was drawn; the others are done
        room = marked.groupBy("source").agg(F.first("room").alias("room"), F.coalesce(F.sum(F.when(F.col("now"), F.col("size"))), F.lit(0)).alias("got"), F.max(F.col("now").cast("int")).alias("any"))
        room = cut(room.select("source", (F.col("room") - F.col("got")).alias("room"), (F.col("any") > 0).alias("on")))
        left = _of_source(left.drop("room"), room)
        again = F.col("on") & (F.col("size") <= F.col("room"))
        decided.append(left.where(~again).select(*columns, F.lit(False).alias("drawn")))
        open_ = small_cut(left.where(again).drop("on"))
        if open_.isEmpty():
            break
    out = decided[0]
    for part in decided[1:]:
        out = out.union(part)
    copies = F.col("whole") + F.when(F.col("drawn"), 1).otherwise(0)
    return out.select(
        F.col("key").alias(key),
        "size",
        "source_size",
        "target",
        (copies * F.col("size")).cast("long").alias("taken"),
        copies.cast("int").alias("copies"),
    )
