"""Connected components of a link table by alternating large-star and small-star rounds.

Few links (``ONE_TASK``) go through the same rounds in one partition and without a shuffle: a row is turned
into two by ``_each``, as a union would spread it over two partitions, and the smallest neighbour comes from
a window, as a join would shuffle.  Spark keeps a thread of the driver for each shuffle and broadcast of the
last minute, and rounds of small tables would make hundreds of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import cut, fewer

#: Links of a round, either way round, that one task takes.
ONE_TASK = 100_000


def _each(df: DataFrame, *pairs: tuple[str, str], names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """A row with columns ``names`` for each of ``pairs`` of columns, for every row of ``df``."""
    rows = [F.struct(*[F.col(c).alias(name) for c, name in zip(pair, names, strict=True)]) for pair in pairs]
    return df.select(F.explode(F.array(*rows)).alias("__row")).select(*[F.col("__row")[name].alias(name) for name in names])


def _relink(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """Large star: each node links its larger neighbours to its smallest; small star: its smaller ones
    and itself.  Beyond ``ONE_TASK`` rows the smallest neighbour comes from a pre-aggregated minimum, so a
    node with very many neighbours is never gathered in one place."""
    few = rows <= ONE_TASK
    if few:
        edges = edges.coalesce(1)
    if large:
        near = _each(edges, ("a", "b"), ("b", "a"))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    if few:
        linked = near.withColumn("m", F.least(F.min("b").over(Window.partitionBy("a")), F.col("a")))
    else:
        least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = fewer(near.join(least, "a"), rows)
    if large:
        out = linked.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = _each(linked, ("b", "m"), ("a", "m"))
    out = out.where(F.col("a") != F.col("b")).distinct()
    return out if few else fewer(out, rows)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); a component is named by its smallest node.

    Rounds go on until the links stop changing; their number grows with the logarithm of the longest
    path.  Null ends and self links are left out; no links give an empty result.
    """

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(links.select("a", "b").where("a <> b").distinct())
    seen = digest(edges)
    edges = fewer(edges, seen[0])
    while seen[0]:
        rows = 2 * seen[0]
        edges = cut(_relink(_relink(edges, True, rows), False, rows))
        now = digest(edges)
        edges = fewer(edges, now[0])
        if now == seen:
            break
        seen = now
    # a star per component is left: every edge points from a node to the smallest one
    star = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return _each(star, ("a", "b"), ("b", "b"), names=("node", "component")).distinct()
