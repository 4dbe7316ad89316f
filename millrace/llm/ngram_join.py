"""Exact Jaccard self-join of word n-gram sets by token-combination prefixes.

A token is an n-gram (by 64-bit hash).  Tokens have one global order: rare ones before frequent ones,
by hash within.  Two sets that reach the threshold differ in few tokens, so they share tokens in short
prefixes of that order.  A set with enough rare tokens is indexed under its first few rare tokens, one
by one.  A set made mostly of frequent tokens gets an extended prefix: frequent tokens fall into
classes by hash, and it is indexed under the pairs of its prefix tokens of a class.  The prefix is
extended until leaving every class with at most one shared token would already mean more differing
tokens than allowed, so no linked pair is missed.  Which tokens count as frequent decides how fast
this is, never what is found.

Sets that agree in a signature become candidates; sizes and parity bitmaps (an upper bound of the
overlap) thin them out, and the rest is verified by counting common tokens.

Rows with equal sets are one class, by a 128-bit fingerprint, and only classes are joined.  Inside, a row
goes by a hash of its key and text, so that rows that share a key, or have none, are told apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import checked_broadcast, cut, small_cut, spread_join
from millrace.llm.components import connected_components
from millrace.llm.wordhash import mix, slices, window_hash, window_starts, words

#: Tokens found in at least this many prefixes are frequent, the ``FREQUENT_MAX`` heaviest at most:
#: 1 MB of hashes, the only data sent to every task.
FREQUENT_DF = 32
FREQUENT_MAX = 1 << 17
#: Salts of the members drawn from open groups.
DRAWS = tuple(range(16))
#: One in so many signatures is compared pair by pair first: pairs that link share many of them.
SPARSE = 4
#: Longs of the bitmaps that are compared inside the join of open groups.
FOLD = 8
_SIZE_STEP = 1.0125
_HASH_BITS = 50


def token_sets(part: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, at): distinct n-gram hashes of text i, ascending, are ``tokens[at[i]:at[i + 1]]``."""
    w = words(part, lower=True)
    count = np.diff(w.first)
    grams = window_hash(w.hash, n, n)
    token = [grams[window_starts(w.first, n)[: len(grams)]]]
    owner = [w.doc[: len(grams)][window_starts(w.first, n)[: len(grams)]]]
    for k in range(1, n):  # the whole of a shorter text is its one token
        short = np.flatnonzero(count == k)
        if len(short):
            token.append(window_hash(w.hash, k, k)[w.first[:-1][short]])
            owner.append(short)
    token, owner = np.concatenate(token), np.concatenate(owner)
    bits = max(1, int(len(part) - 1).bit_length())
    order = np.argsort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (token >> np.uint64(bits)), kind="stable")
    token, owner = token[order], owner[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    return token, np.searchsorted(owner, np.arange(len(part) + 1))


def allowed(size: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of ``size`` that a partner may lack."""
    return size - (size * percent + 99) // 100


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def bitmaps(token: np.ndarray, at: np.ndarray) -> list[bytes]:
    """Parity bitmaps: bit b is the parity of the number of tokens with hash b, one bit a token or more."""
    size = np.diff(at)
    n_bits = 1 << np.ceil(np.log2(np.maximum(size, 64))).astype(np.int64)
    base = np.concatenate([[0], np.cumsum(n_bits)])
    owner = np.repeat(np.arange(len(size)), size)
    place = base[owner] + (mix(token) & (n_bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(base[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def folded(token: np.ndarray, at: np.ndarray) -> pa.ListArray:
    """Parity bitmaps of 64 * ``FOLD`` bits whatever the size, as longs."""
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    place = owner * (64 * FOLD) + (mix(token) % np.uint64(64 * FOLD)).astype(np.int64)
    bits = (np.bincount(place, minlength=(len(at) - 1) * 64 * FOLD) & 1).astype(np.uint8)
    longs = np.packbits(bits, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(np.arange(0, len(longs) + 1, FOLD, dtype=np.int32), pa.array(longs))


def most_common(a: bytes, b: bytes, size_a: int, size_b: int) -> int:
    """Upper bound of the overlap of two sets by their bitmaps; the longer one is folded."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), 8 * len(a)
    while bits > 8 * len(b):
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (size_a + size_b - (x ^ int.from_bytes(b, "little")).bit_count()) // 2


def _node(size: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Sets as numbers: a size class above some bits of the set's hash.  Sets that share a number are
    told apart by the full hash later."""
    step = (np.log(np.maximum(size, 1)) / np.log(_SIZE_STEP)).astype(np.uint64)
    return ((step << np.uint64(_HASH_BITS)) | (low >> np.uint64(64 - _HASH_BITS))).astype(np.int64)


def _pair_signatures(frequent: np.ndarray, need: int, level: int) -> np.ndarray:
    """Signatures of 2-combinations in the shortest prefix of ``frequent`` (in order) that holds
    ``need`` more tokens than classes it touches."""
    group = (mix(frequent ^ np.uint64(0x5DEECE66D)) % np.uint64(1 << level)).astype(np.int64)
    _, first = np.unique(group, return_index=True)
    spare = np.ones(len(group), np.int64)
    spare[first] = 0
    stop = int(np.searchsorted(np.cumsum(spare), need)) + 1
    group, frequent = group[:stop], frequent[:stop]
    order = np.argsort(group, kind="stable")
    group, frequent = group[order], frequent[order]
    left, right = [], []
    for members in np.split(np.arange(stop), np.flatnonzero(np.diff(group)) + 1):
        for i, j in combinations(members.tolist(), 2):
            left.append(i)
            right.append(j)
    return mix(frequent[left] * np.uint64(0xA24BAED4963EE407) + frequent[right] + np.uint64(level))


def _describe(kind: str, n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(2)):
                token, at = token_sets(part, n)
                size = np.diff(at)
                low, high = _sums(mix(token), at), _sums(mix(token ^ np.uint64(0x9E6C63D0876A9A47)), at)
                ends = at[:-1] + np.where(size > 0, allowed(size, percent) + 1, 0)
                short = np.arange(len(token)) < np.repeat(ends, size)
                at32 = np.concatenate([[0], np.cumsum(ends - at[:-1])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        batch.column(1).slice(first, len(part)),
                        pa.array(size.astype(np.int64)),
                        pa.array(low.view(np.int64)),
                        pa.array(high.view(np.int64)),
                        pa.array(_node(size, low)),
                        pa.array(bitmaps(token, at), pa.binary()),
                        folded(token, at),
                        pa.ListArray.from_arrays(at32, pa.array(token[short].view(np.int64))),
                    ],
                    ["key", "id", "size", "low", "high", "node", "bitmap", "fold", "prefix"],
                )

    return run, f"key {kind}, id long, size long, low long, high long, node long, bitmap binary, fold array<long>, prefix array<long>"


def _signatures(n: int, percent: int, frequent: np.ndarray):
    smallest = -(-percent // (100 - percent))  # smaller sets are linked only to equal ones

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in slices(batch.column(0)):
                token, at = token_sets(part, n)
                size = np.diff(at)
                node = _node(size, _sums(mix(token), at))
                owner = np.repeat(np.arange(len(size)), size)
                place = np.searchsorted(frequent, token)
                heavy = np.zeros(len(token), bool)
                inside = place < len(frequent)
                heavy[inside] = frequent[place[inside]] == token[inside]
                rare = np.concatenate([[0], np.cumsum(~heavy)])
                n_rare = rare[at[1:]] - rare[at[:-1]]
                want = allowed(size, percent) + 1
                indexed = size >= smallest
                single = ~heavy & indexed[owner] & (rare[:-1] - rare[at[:-1]][owner] < want[owner])
                sig, of = [token[single]], [node[owner[single]]]
                for i in np.flatnonzero(indexed & (n_rare < want)):
                    own = token[at[i] : at[i + 1]][heavy[at[i] : at[i + 1]]]
                    level = max(0, int(want[i]).bit_length() - 2)
                    for at_level in (level, level + 1):  # a partner's size may lie in the next level
                        sig.append(_pair_signatures(own, int(want[i] - n_rare[i]), at_level))
                        of.append(np.full(len(sig[-1]), node[i]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(of))], ["sig", "node"]
                )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(1)):
                token, at = token_sets(part, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        pa.array(_sums(mix(token), at).view(np.int64)),
                        pa.ListArray.from_arrays(at.astype(np.int32), pa.array(token.view(np.int64))),
                    ],
                    ["id", "low", "tokens"],
                )

    return run, "id long, low long, tokens array<long>"


def _plausible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("bitmap_a", "bitmap_b", "size_a", "size_b")), strict=True)
            keep = [(100 + percent) * most_common(a, b, m, n) >= percent * (m + n) for a, b, m, n in rows]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "low_a", "size_a", "b", "low_b", "size_b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets reach the threshold, as links (a, b)."""
    p = pairs
    for side in ("a", "b"):
        p = p.join(sets.select(F.col("id").alias(side), F.col("low").alias(f"low_{side}"), F.col("tokens").alias(f"tokens_{side}")), [side, f"low_{side}"])
    both = F.size(F.array_intersect("tokens_a", "tokens_b"))
    return p.where(both * 100 >= (F.col("size_a") + F.col("size_b") - both) * percent).select("a", "b")


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    for side in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}")), side, "left")
        pairs = pairs.withColumn(f"of_{side}", F.coalesce(f"of_{side}", side))
    return pairs.where("of_a <> of_b")


def _likely_pairs(open_: DataFrame, salts: tuple[int, ...], percent: int) -> DataFrame:
    """(x, y): members of a signature in different components that sizes and bitmaps allow to link.

    With ``salts``, members are compared with one drawn member a salt; without, with each other, but for
    those that were compared with all before.
    """
    columns = [c for c in open_.columns if c not in ("sig", "done")]
    if salts:
        drawn = [F.min(F.struct(F.xxhash64("node", F.lit(s)), *columns)) for s in salts]
        right = open_.groupBy("sig").agg(F.array_distinct(F.array(*drawn)).alias("drawn")).select("sig", F.explode("drawn").alias("y"))
        right = right.select("sig", *[F.col(f"y.{c}").alias(f"y_{c}") for c in columns])
        left = open_
    else:
        left = open_.where(~F.col("done"))
        right = left.select("sig", *[F.col(c).alias(f"y_{c}") for c in columns])
    left = left.select("sig", *[F.col(c).alias(f"x_{c}") for c in columns])
    differ = sum((F.bit_count(F.col(f"x_f{i}").bitwiseXOR(F.col(f"y_f{i}"))) for i in range(1, FOLD)), F.bit_count(F.col("x_f0").bitwiseXOR(F.col("y_f0"))))
    total = F.col("x_size") + F.col("y_size")
    likely = (total - differ) * (100 + percent) >= total * (2 * percent)
    near_size = F.least("x_size", "y_size") * 100 >= F.greatest("x_size", "y_size") * percent
    once = F.lit(True) if salts else F.col("x_node") < F.col("y_node")
    met = left.join(right, "sig").where(once & (F.col("x_of") != F.col("y_of")) & near_size & likely)
    return met.select(F.col("x_node").alias("x"), F.col("y_node").alias("y"))


def ngram_jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set holds its distinct n-word
    shingles, or its whole word sequence if that is shorter.  Two documents link when their sets'
    Jaccard similarity is at least ``percent`` / 100.  ``component_id`` is the smallest key that can be
    reached by links, itself included.

    Equal sets are one class, and only classes are joined.  Within a signature, classes are first compared
    with its smallest and largest member, which settles groups of near copies of any size; what is then
    still in different components is compared directly.

    Null texts, and texts without words, have empty sets and link with nothing, so they are their own
    component.  Rows are judged by their text: those that share a key but not the text are documents of
    their own, and repeated rows get equal answers.  A row without a key links like any other; it gets the
    smallest key of its component, and null if there is none.  Ties cannot arise, as a link needs only the
    threshold.  A very long text is one set, and in memory once while it is hashed.  An empty table gives an
    empty result; other columns are not read.
    """
    if not 70 <= percent <= 99:
        raise ValueError("percent must be from 70 to 99")
    kind = docs.schema[key].dataType.simpleString()
    row = F.xxhash64(docs[key].isNull(), docs[key], docs[text])
    rows = docs.select(docs[key].alias("key"), row.alias("id"), docs[text].alias("text"))
    base = cut(rows.mapInArrow(*_describe(kind, n, percent)))

    prefix = base.where("size > 0").select(F.explode("prefix").alias("token"))
    heavy = prefix.groupBy("token").count().where(F.col("count") >= FREQUENT_DF).orderBy(F.desc("count"), "token").limit(FREQUENT_MAX)
    frequent = np.sort(np.array([r.token for r in heavy.collect()], np.int64).view(np.uint64))

    # copies within a task are taken out before anything is sent
    sigs = rows.select("text").mapInArrow(_signatures(n, percent, frequent), "sig long, node long")
    ends = sigs.groupBy("sig").agg(F.min("node").alias("first"), F.max("node").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    members = small_cut(spread_join(sigs, cut(ends), "sig").distinct())

    classes = base.where("size > 0").groupBy("low", "high").agg(F.min("id").alias("rep"), F.min("key").alias("least"), F.count(F.lit(1)).alias("n"), F.min("size").alias("size"), F.min("node").alias("node"), F.first("bitmap").alias("bitmap"), F.first("fold").alias("fold"))
    classes = small_cut(classes)
    apart = int(np.ceil(np.log(100 / percent) / np.log(_SIZE_STEP))) + 1
    near = F.abs(F.shiftright("x", _HASH_BITS) - F.shiftright("y", _HASH_BITS)) <= apart

    def candidates(pairs: DataFrame) -> DataFrame:
        """Pairs of nodes (x, y) as pairs of classes that sizes and bitmaps allow."""
        p = pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).where((F.col("x") != F.col("y")) & near).distinct()
        for node, side in (("x", "a"), ("y", "b")):
            p = p.join(classes.select(F.col("node").alias(node), *[F.col(c).alias(f"{o}{side}") for c, o in (("rep", ""), ("low", "low_"), ("size", "size_"), ("bitmap", "bitmap_"))]), node)
        p = p.where(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent).drop("x", "y")
        return p.mapInArrow(_plausible(percent), "a long, low_a long, size_a long, b long, low_b long, size_b long")

    def sets_of(pairs: DataFrame) -> DataFrame:
        used = small_cut(pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("id")))
        found = rows.select("id", "text").join(checked_broadcast(used, 24), "id", "left_semi").mapInArrow(*_sets(n))
        return small_cut(found.dropDuplicates(["id", "low"]), 5_000)

    star = members.select(F.col("node").alias("x"), F.col("first").alias("y")).union(members.select(F.col("node").alias("x"), F.col("last").alias("y")))
    pairs = small_cut(candidates(star))
    sets = sets_of(pairs)
    # one pair of each class first: most others then lie inside a component
    one = pairs.groupBy("b").agg(F.min("a").alias("a"))
    links = small_cut(_verified(pairs.join(one, ["a", "b"]), sets, percent))
    labels = connected_components(links)
    rest = _across(pairs, labels).join(one, ["a", "b"], "left_anti")
    links = small_cut(links.union(_verified(rest, sets, percent)))
    labels = small_cut(connected_components(links))

    # Signatures whose members are still in different components: their members are compared with a few
    # drawn ones, then pair by pair, in one of ``SPARSE`` signatures first and at last in all that are
    # still open.  Each step joins up most of what the next one would have found many times over.  The
    # bound of the overlap by folded bitmaps is part of the join's condition, so only likely links come
    # out of it.
    facts = classes.select("node", "rep", "size", *[F.col("fold")[i].alias(f"f{i}") for i in range(FOLD)])
    members = members.where("n > 3").select("sig", "node", ((F.col("node") == F.col("first")) | (F.col("node") == F.col("last"))).alias("done"))
    for salts, sparse in ((DRAWS, 1), ((), SPARSE), ((), 1)):
        of = facts.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("of", F.coalesce("component", "rep")).drop("rep", "component")
        open_ = members.join(of, "node")
        mixed = open_.groupBy("sig").agg(F.min("of").alias("low_of"), F.max("of").alias("high_of")).where("low_of <> high_of").select("sig")
        open_ = small_cut(open_.join(mixed, "sig"))
        asked = open_.where(F.pmod(F.xxhash64("sig"), F.lit(sparse)) == 0)
        more = small_cut(candidates(_likely_pairs(asked, salts, percent)))
        links = small_cut(links.union(_verified(more, sets_of(more), percent)))
        labels = small_cut(connected_components(links))

    named = classes.select("low", "high", "rep", "least", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.withColumn("component", F.coalesce("component", "rep"))
    reached = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(named.join(reached, "component").select("low", "high", "n", "component_id"))
    out = spread_join(base.where("size > 0").select("key", "size", "low", "high"), named, ["low", "high"]).select("key", "size", F.coalesce("component_id", "key").alias("component_id"))
    out = out.union(base.where("size = 0").select("key", "size", F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), F.col("size").alias("n_shingles"), "component_id")
