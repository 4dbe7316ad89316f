"""URL filtering by dated block lists: a temporal list join, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOREVER = "9999-12-31 00:00:00"


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def _up_to(first: int, last: Column, key) -> Column:
    """key(k) for k from ``first`` to ``last``, an empty array if there is none."""
    return F.when(last >= first, F.transform(F.sequence(F.lit(first), last), key)).otherwise(F.array().cast("array<string>"))


def url_keys(url: Column) -> Column:
    """List keys under which a URL can be named: its host, every parent domain above it that still has a
    dot, and its host with every prefix of the path that ends with a segment (without a slash behind it).
    Empty for null or host-less URLs.  Their number is bounded by the URL's dots and slashes."""
    host = url_host(url)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    named = F.struct(host.alias("host"), F.split(host, r"\.").alias("labels"), F.split(path, "/").alias("segments"))

    def keys(u: Column) -> Column:
        labels, segments = u["labels"], u["segments"]
        parents = _up_to(2, F.size(labels) - 1, lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
        ends = _up_to(2, F.size(segments), lambda k: F.when(F.element_at(segments, k) != "", F.array_join(F.slice(segments, F.lit(1), k), "/")))
        return F.concat(F.array(u["host"]), parents, F.transform(F.array_compact(ends), lambda end: F.concat(u["host"], end)))

    # bound once, so that the URL is taken apart once and not for every key
    found = F.element_at(F.transform(F.array(named), keys), 1)
    return F.when(host.isNotNull(), F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def _slot(at: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(at.cast("timestamp")) / F.lit(seconds * 1_000_000))


def _nearest(rows: DataFrame, order: Column, block: int = 64) -> DataFrame:
    """(key, slot, value) with ``nearest``: the value of the last row before it of its key, by ``order`` (a
    whole number), that has one.

    Rows are put in order inside blocks of ``block`` slots, and blocks by one row each, so a key with rows
    in very many slots is not ordered in one place.
    """
    at = rows.withColumn("__at", order).withColumn("__block", F.floor(F.col("__at") / block))
    inside = Window.partitionBy("key", "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("__in", F.last("value", ignorenulls=True).over(inside))
    ends = at.groupBy("key", "__block").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("__at"))).alias("end"))
    across = Window.partitionBy("key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("key", "__block", F.last("end", ignorenulls=True).over(across).alias("__end"))
    return at.join(ends, ["key", "__block"]).select("key", "slot", "value", F.coalesce("__in", "__end").alias("nearest"))


def validity_intervals(entries: DataFrame, key: str, at: str, listed: str, slot_seconds: int = 6 * 3600) -> DataFrame:
    """(key, valid_from, valid_to, listed): each entry holds from its date to the next later one of its key.

    Of entries with the same key and date a listing wins.  Rows with a null key, date or action say
    nothing and are left out.  An entry's end is the next date inside its (key, time slot), or else
    the first one of the key's next slot, so a key with very many entries is ordered slot by slot.
    """
    e = entries.select(entries[key].alias("key"), entries[at].alias("valid_from"), entries[listed].cast("int").alias("listed")).na.drop()
    e = e.groupBy("key", "valid_from").agg(F.max("listed").alias("listed")).withColumn("slot", _slot(F.col("valid_from"), slot_seconds))
    starts = e.groupBy("key", "slot").agg(F.min("valid_from").alias("value"))
    after = _nearest(starts, -F.col("slot")).select("key", "slot", F.col("nearest").alias("beyond"))
    inside = F.lead("valid_from").over(Window.partitionBy("key", "slot").orderBy("valid_from"))
    e = e.withColumn("inside", inside).join(after, ["key", "slot"])
    return e.select("key", "slot", "valid_from", F.coalesce("inside", "beyond").alias("valid_to"), "listed")


def filter_urls(
    captures: DataFrame,
    entries: DataFrame,
    url: str = "url",
    fetched: str = "fetched",
    key: str = "key",
    at: str = "at",
    listed: str = "listed",
    slot_seconds: int = 6 * 3600,
) -> DataFrame:
    """Each capture with the entries of its keys that were active when it was fetched.

    ``entries`` has dated actions per list key (``listed`` 1: from then on the key is listed, 0: it no
    longer is).  They become validity intervals [valid_from, valid_to); a capture matches a key if its
    fetch time lies in an interval with ``listed`` 1.  Returns the columns of ``captures`` with
    ``blocked`` boolean, ``n_rules`` long (keys active at the time), ``rule`` string (the longest of
    them, ties by code point) and ``listed_since`` (its valid_from).

    The as-of join is a running last value over entries and captures in time order, cut into
    (key, time slot) groups; the state at the start of a slot comes from the last entry of each earlier
    slot, at most one row per key and slot.  So neither a host with a third of the captures nor a key
    with very many entries is ordered in one task, and work is linear in both.

    Null, empty or malformed URLs and null fetch times match nothing; a very long URL has as many keys as
    it has dots and slashes.  Of entries with one key and date a listing wins, and an entry dated at the
    moment of a fetch is active.  Repeated captures are judged one by one.  Empty lists block nothing; no
    captures give no rows.  Columns named like the added ones are replaced, all others are returned.
    """
    spans = validity_intervals(entries, key, at, listed, slot_seconds)
    row = "__capture"
    added = ("blocked", "n_rules", "rule", "listed_since")
    caps = captures.drop(*added)
    # equal (url, time) pairs have equal answers, so the join runs over these
    asked = caps.select(F.col(url).alias("url"), F.col(fetched).alias("t")).where(F.col("url").isNotNull() & F.col("t").isNotNull()).distinct()
    probes = asked.select("url", "t", F.explode(url_keys(F.col("url"))).alias("key")).withColumn("slot", _slot(F.col("t"), slot_seconds))
    span = F.struct(F.col("valid_from"), F.col("valid_to"), F.col("listed"))

    last = spans.groupBy("key", "slot").agg(F.max_by(span, "valid_from").alias("last"))
    slots = last.unionByName(probes.select("key", "slot").distinct(), allowMissingColumns=True)
    slots = slots.groupBy("key", "slot").agg(F.max("last").alias("value"))
    carried = _nearest(slots, F.col("slot")).select("key", "slot", F.col("nearest").alias("carried"))

    line = spans.select("key", "slot", F.col("valid_from").alias("t"), F.lit(0).alias("order"), F.lit(None).cast("string").alias("url"), span.alias("span"))
    line = line.unionByName(probes.select("key", "slot", "t", F.lit(1).alias("order"), "url"), allowMissingColumns=True)
    so_far = Window.partitionBy("key", "slot").orderBy("t", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = line.withColumn("span", F.last("span", ignorenulls=True).over(so_far)).where("order = 1")
    hit = line.join(carried, ["key", "slot"]).withColumn("span", F.coalesce("span", "carried"))
    hit = hit.where((F.col("span.listed") == 1) & (F.col("t") >= F.col("span.valid_from")))
    best = F.max_by(F.struct("key", F.col("span.valid_from").alias("since")), F.struct(F.length("key"), "key"))
    verdict = hit.groupBy("url", "t").agg(F.count(F.lit(1)).alias("n_rules"), best.alias("best"))
    verdict = verdict.select(F.col("url").alias(f"{row}_url"), F.col("t").alias(f"{row}_t"), F.col("n_rules").alias(f"{row}_n"), F.col("best").alias(f"{row}_best"))
    out = caps.join(verdict, (F.col(url) == F.col(f"{row}_url")) & (F.col(fetched) == F.col(f"{row}_t")), "left")
    return out.select(
        *[caps[c] for c in caps.columns],
        F.col(f"{row}_n").isNotNull().alias("blocked"),
        F.coalesce(f"{row}_n", F.lit(0)).cast("long").alias("n_rules"),
        F.col(f"{row}_best.key").alias("rule"),
        F.col(f"{row}_best.since").alias("listed_since"),
    )
