"""Sharding by jump consistent hashing, with DataFrame functions only.

The jump hash of a key walks a pseudo-random increasing sequence of shard numbers that depends on
the key alone and stops at the last one below the shard count.  No ring table is kept, and one more
shard changes the answer only for keys whose walk visits exactly that new number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checked_broadcast, cut


def jump_hash(key: Column, shards: int) -> Column:
    """Shard (0 to ``shards`` - 1) of ``key``; null keys are keys like any other.

    Step i of the walk draws its number from xxhash64(key, i), so every engine that has that hash
    and doubles gets the same shards.  A walk takes about log(shards) steps: some more than that are laid
    out for every key, and only a key that has not arrived by then goes on.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(state: Column, i: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(key, i), 33) + F.lit(1)
        onward = F.floor((state["next"] + 1) * (F.lit(float(1 << 31)) / draw))
        going = state["next"] < shards
        return F.struct(
            F.when(going, state["next"]).otherwise(state["at"]).alias("at"),
            F.when(going, F.least(onward, F.lit(shards).cast("long"))).otherwise(state["next"]).alias("next"),
        )

    start = F.struct(F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("next"))
    usual = min(shards, 16 + 4 * shards.bit_length())
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(usual)), start, step)
    if usual < shards:
        # bound once, so that the usual steps are not walked again for every mention
        onward = F.transform(F.array(walked), lambda s: F.when(s["next"] < shards, F.aggregate(F.sequence(F.lit(usual + 1), F.lit(shards)), s, step)).otherwise(s))
        walked = F.element_at(onward, 1)
    return walked["at"].cast("int")


def assign_shards(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", buckets: int | None = None, chunk: int = 1 << 16) -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) for every row of ``docs``.

    ``shard`` is the jump hash of the key under ``shards`` shards, ``grown_shard`` the one under one
    more.  ``slot`` numbers the rows of a shard from 0 without gaps, in an order of hashes of key and text:
    rows are numbered inside (shard, bucket of that hash), and a running sum of counts, one a bucket, gives
    each bucket its first slot, so no task ever orders a whole shard, not even of rows with one key.
    ``buckets`` per shard are one per 20,000 rows (64 at least) if unset.

    Null text: size 1, crc32 0, like an empty text; a very long text is measured where it is read.  Null keys
    form one key.  Repeated keys share a shard and have slots of their own; rows equal in key and text are
    counted before they are numbered, and laid out ``chunk`` by chunk.  An empty table gives an empty result.
    Other columns of ``docs`` are not read.
    """
    id_ = docs[key]
    body = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(
        id_.alias("key"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("text_crc32"),
        jump_hash(id_, shards).alias("shard"),
        jump_hash(id_, shards + 1).alias("grown_shard"),
        F.xxhash64(id_, body).alias("place"),
    )
    rows = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))  # the texts are read once
    buckets = buckets or max(64, rows.count() // (20_000 * shards))
    rows = rows.withColumn("bucket", F.pmod("place", F.lit(buckets)).cast("int"))
    counts = rows.groupBy("shard", "bucket").agg(F.sum("n").alias("own"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(counts.select("shard", "bucket", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("shard", "bucket").orderBy("place", "key", "text_crc32", "size")
    numbered = rows.withColumn("upto", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = numbered.join(checked_broadcast(base, 32), ["shard", "bucket"]).withColumn("first", F.col("base") + F.col("upto") - F.col("n"))

    def laid_out(part: DataFrame, slot: Column) -> DataFrame:
        return part.select(F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")

    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(chunk).cast("long")))
    many = placed.where("n > 1").withColumn("from", chunks).repartition("place", "from")
    each = F.explode(F.sequence(F.col("first") + F.col("from"), F.col("first") + F.least(F.col("n"), F.col("from") + chunk) - 1))
    return laid_out(placed.where("n = 1"), F.col("first")).union(laid_out(many.withColumn("nth", each), F.col("nth")))
