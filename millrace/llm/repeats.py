"""Removal of repeated passages: every word that an earlier equal window covers goes.

1. Documents with equal word sequences (equal top symbols) keep one copy, the one with the smallest key.
2. Each text is recompressed.  Windows are cut into segments that share an anchor, a high-level symbol
   with its context; names found once cannot hold a repeat.
3. Only windows at anchors found more than once get a full fingerprint, and of equal windows all but
   the first, by (key, hash of the text, position), are repeats.

A document is named by its key, and where a key has several texts, also by a hash of the text.

Names and fingerprints are combined inside a task before the shuffle: a task sends each at most once,
however often it occurs there, so a passage found in a third of all documents stays spread out.  They
travel in arrays per (slice of texts, hash bucket).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import BROADCAST_BYTES, checked_broadcast, cut
from millrace.llm.recompress import SCHEDULE, anchors, lay_out, levels
from millrace.llm.wordhash import mix, slices, window_hash, window_starts, words

#: Text whose names and fingerprints are combined before they are sent.
COMBINE_BYTES = 4 << 20
_NULL_KEY = -(1 << 63)
_ALL = -1  # in place of a window's position: the whole document


def _lists(values: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.asarray(at, np.int32), pa.array(values.view(np.int64)))


def _by_bucket(bucket: np.ndarray, columns: list[np.ndarray]) -> tuple[np.ndarray, list[pa.ListArray]]:
    order = np.argsort(bucket, kind="stable")
    number, at = np.unique(bucket[order], return_index=True)
    at = np.append(at, len(order))
    return number, [_lists(c[order], at) for c in columns]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _flat(column) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0, np.int64)])


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name of the whole word sequence of each text."""
    for batch in batches:
        for first, part in slices(batch.column(2)):
            w = words(part)
            n = np.diff(w.first)
            nth = np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)
            sums = []
            for salt in (0x8CB92BA72F3D8DD7, 0x3C79AC492BA7B653):
                total = np.zeros(len(w.hash) + 1, np.uint64)
                np.cumsum(mix(w.hash ^ mix(nth.astype(np.uint64) + np.uint64(salt))), out=total[1:])
                sums.append((total[w.first[1:]] - total[w.first[:-1]]).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, len(part)), batch.column(1).slice(first, len(part)), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])],
                ["id", "h", "n_words", "high", "low"],
            )


def _again(high: np.ndarray, low: np.ndarray, id_: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, again): fingerprints in order with their places, and which of them repeat an earlier place.
    The same place may come more than once, from rows that share a key and a text."""
    order = np.lexsort((at, h, id_, low, high))
    high, low, id_, h, at = high[order], low[order], id_[order], h[order], at[order]
    new = np.ones(len(order), bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order, (id_ != id_[first]) | (h != h[first]) | (at != at[first])


_ENTRIES = "bucket int, sure boolean, high array<long>, low array<long>, id array<long>, h array<long>, at array<long>"
_NAMES = ["bucket", "sure", "high", "low", "id", "h", "at"]
_PLACES = "id long, h long, at long"


def _send(sure: np.ndarray, high: np.ndarray, low: np.ndarray, id_: np.ndarray, h: np.ndarray, at: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Entries by hash bucket; sure ones, already decided, go along unhashed."""
    empty = np.zeros(0, np.int64)
    if sure.any():
        one = np.array([0, int(sure.sum())])
        none = np.array([0, 0])
        where = int(mix(np.array([id_[sure][0]]).astype(np.uint64))[0] % np.uint64(buckets))
        yield pa.RecordBatch.from_arrays(
            [pa.array([where], pa.int32()), pa.array([True]), _lists(empty, none), _lists(empty, none), _lists(id_[sure], one), _lists(h[sure], one), _lists(at[sure], one)],
            _NAMES,
        )
    if not sure.all():
        bucket = (high[~sure] % np.uint64(buckets)).astype(np.int32)
        number, columns = _by_bucket(bucket, [high[~sure], low[~sure], id_[~sure], h[~sure], at[~sure]])
        yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.zeros(len(number), bool)), *columns], _NAMES)


def _segments(window: int, buckets: int, schedule: str):
    """Per anchor name of a slice: an entry with its only segment, or sure entries for several ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(2), COMBINE_BYTES):
                id_, h = (_numbers(batch.column(c).slice(first, len(part))) for c in (0, 1))
                w = words(part)
                fits = window_starts(w.first, window)
                if not fits.any():
                    continue
                symbols, place = lay_out(w.hash, w.first)
                at = place[fits]
                name, start = anchors(levels(symbols, schedule), at, window)
                new = np.ones(len(name), bool)
                new[1:] = (name[1:] != name[:-1]) | (start[1:] != start[:-1]) | (at[1:] != at[:-1] + 1)
                head = np.flatnonzero(new)
                length = np.diff(np.append(head, len(name)))
                doc = w.doc[fits][head]
                begin = np.flatnonzero(fits)[head] - w.first[doc]
                name = name[head]
                _, one, back, count = np.unique(name, return_index=True, return_inverse=True, return_counts=True)
                many = count[back] > 1
                where = (begin.astype(np.int64) << 16) | length
                yield from _send(np.ones(int(many.sum()), bool), name[many], name[many], id_[doc][many], h[doc][many], where[many], buckets)
                # a name that is sure here is still to be met by other slices: its entry has no segment
                open_ = np.zeros(len(one), bool)
                yield from _send(open_, name[one], np.zeros(len(one), np.uint64), id_[doc][one], h[doc][one], np.where(many, 0, where)[one], buckets)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Segments of one bucket whose name was met in more than one slice, and all sure ones."""
    table = table.combine_chunks()
    sure = table.filter(table["sure"])
    rest = table.filter(pc.invert(table["sure"]))
    _, back, count = np.unique(_flat(rest["high"]), return_inverse=True, return_counts=True)
    at = _flat(rest["at"])
    hit = (count[back] > 1) & (at > 0)
    return pa.table({c: np.concatenate([_flat(sure[c]), _flat(rest[c])[hit]]) for c in ("id", "h", "at")})


def _later(table: pa.Table) -> pa.Table:
    """Windows of one bucket that an equal, earlier one precedes, and all sure ones."""
    table = table.combine_chunks()
    sure = table.filter(table["sure"])
    rest = table.filter(pc.invert(table["sure"]))
    high, low, id_, h, at = (_flat(rest[c]) for c in ("high", "low", "id", "h", "at"))
    order, again = _again(high, low, id_, h, at)
    hit = order[again]
    return pa.table({c: np.concatenate([_flat(sure[c]), v[hit]]) for c, v in (("id", id_), ("h", h), ("at", at))})


def _windows(window: int, buckets: int):
    """Fingerprints of the windows at shared anchors; repeats inside a slice are sure already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(2), COMBINE_BYTES):
                id_, h = (_numbers(batch.column(c).slice(first, len(part))) for c in (0, 1))
                asked = batch.column(3).slice(first, len(part))
                w = words(part)
                at = asked.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(part)), np.diff(asked.offsets.to_numpy()))
                begin, length = w.first[doc] + (at >> 16), at & 0xFFFF
                mark = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(mark, begin, 1)
                np.add.at(mark, begin + length, -1)
                place = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                if not len(place):
                    continue
                high, low = window_hash(w.hash, window, 1)[place], window_hash(mix(w.hash), window, 2)[place]
                doc = w.doc[place]
                key, h, at = id_[doc], h[doc], place - w.first[doc]
                order, again = _again(high, low, key, h, at)
                yield from _send(again, high[order], low[order], key[order], h[order], at[order], buckets)

    return run


def _kept(window: int):
    """Number of words, number of removed ones and the rest joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(1)):
                gone = batch.column(2).slice(first, len(part))
                w = words(part)
                n = np.diff(w.first)
                at = gone.flatten().to_numpy(zero_copy_only=False)
                doc = np.repeat(np.arange(len(part)), np.diff(gone.offsets.to_numpy()))
                mark = np.zeros(len(w.hash) + 1, np.int64)
                whole = at == _ALL
                begin = w.first[doc] + np.where(whole, 0, at)
                np.add.at(mark, begin, 1)
                np.add.at(mark, np.where(whole, w.first[doc + 1], begin + window), -1)
                keep = np.cumsum(mark)[:-1] == 0
                kept = np.concatenate([[0], np.cumsum(keep)])
                n_kept = kept[w.first[1:]] - kept[w.first[:-1]]
                start, end, owner = w.start[keep], w.end[keep], w.doc[keep]
                last = np.ones(len(owner), bool)
                last[:-1] = owner[1:] != owner[:-1]
                data = w.data.copy()
                data[end[~last]] = 32  # the white space behind a kept word that another one follows
                step = np.zeros(len(data) + 2, np.int8)
                step[start] += 1
                np.subtract.at(step, end + ~last, 1)
                taken = np.cumsum(step, dtype=np.int8)[: len(data)] > 0
                size = np.concatenate([[0], np.cumsum(taken)])[w.text_at]
                text = pa.StringArray.from_buffers(len(part), pa.py_buffer((size - size[0]).astype(np.int32)), pa.py_buffer(data[taken].tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), pa.array(n.astype(np.int64)), pa.array((n - n_kept).astype(np.int64)), text],
                    ["id", "n_words", "n_removed", "kept"],
                )

    return run


def _told_apart(rows: DataFrame) -> DataFrame:
    """(id, h, text) of (id, text): ``h`` is a hash of the text where an id has several, else 0, which is
    cheap to send.  With more such ids than can be broadcast every row gets the hash."""
    full = F.xxhash64("text")
    several = cut(rows.groupBy("id").agg(F.min(full).alias("least"), F.max(full).alias("most")).where("least < most").select("id"))
    n = several.count()
    if not n:
        return rows.select("id", F.lit(0).cast("long").alias("h"), "text")
    if n * 16 > BROADCAST_BYTES:
        return rows.select("id", full.alias("h"), "text")
    marked = rows.join(F.broadcast(several.withColumn("shared", F.lit(True))), "id", "left")
    return marked.select("id", F.when(F.col("shared"), full).otherwise(F.lit(0)).alias("h"), "text")


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 50, buckets: int | None = None, schedule: str = SCHEDULE) -> DataFrame:
    """(key, n_words, n_removed, kept) for every row of ``docs``; ``key`` is an integer column.

    Words are ``[^\\x20\\x09-\\x0D]+``.  A word is removed if some window of ``window`` consecutive words
    of its document covers it whose word sequence also starts earlier: in a document with a smaller key,
    or at an earlier word of the same one.  ``kept`` is the rest joined by single spaces.

    ``buckets`` hash buckets share names and fingerprints out; unset, four per shuffle partition.

    Null texts have no words, and texts shorter than a window lose none; ``kept`` is then the text's
    words, or ''.  Rows with equal key and text are one document in the comparison; different texts under
    one key, or under none, are documents of their own, in order of a hash of the text.  A null key is
    smaller than all others.  An empty table gives an empty result; other columns are not read.
    """
    if not 2 <= window < 1 << 16:
        raise ValueError("window must be from 2 to 65535")
    session = docs.sparkSession
    buckets = buckets or 4 * int(session.conf.get("spark.sql.shuffle.partitions"))
    rows = _told_apart(docs.select(F.coalesce(docs[key].cast("long"), F.lit(_NULL_KEY)).alias("id"), docs[text].alias("text")))
    doc = ["id", "h"]

    roots = cut(rows.mapInArrow(_roots, "id long, h long, n_words long, high long, low long").where(F.col("n_words") >= window))
    place = F.struct(*doc)
    least = roots.groupBy("high", "low").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most")
    copies = cut(roots.join(least, ["high", "low"]).where(place > F.col("least")).select(*doc).distinct())
    unique = rows.join(checked_broadcast(copies, 24), doc, "left_anti")

    entries = unique.mapInArrow(_segments(window, buckets, schedule), _ENTRIES)
    hits = entries.groupBy("bucket").applyInArrow(_shared, _PLACES)
    asked = hits.groupBy(*doc).agg(F.collect_list("at").alias("at"))
    suspects = rows.join(asked, doc, "left").where(F.col("at").isNotNull()).select(*doc, "text", "at")
    found = suspects.mapInArrow(_windows(window, buckets), _ENTRIES)
    later = found.groupBy("bucket").applyInArrow(_later, _PLACES)
    gone = later.union(copies.select(*doc, F.lit(_ALL).cast("long").alias("at"))).groupBy(*doc).agg(F.collect_list("at").alias("at"))

    judged = rows.join(gone, doc, "left").select("id", "text", F.coalesce("at", F.array().cast("array<long>")).alias("at"))
    out = judged.mapInArrow(_kept(window), "id long, n_words long, n_removed long, kept string")
    back = F.when(F.col("id") != _NULL_KEY, F.col("id")).cast(docs.schema[key].dataType)
    return out.select(back.alias(key), "n_words", "n_removed", "kept")
