"""Benchmark decontamination over a positional inverted index, with DataFrame functions only.

Test windows are looked up by their rarest words: the index holds, for every word that is one of the
rarest few of some window, its positions in all documents.  Posting lists shifted by the word's offset
in the window are intersected, and what agrees is checked word by word: exact phrase matches.  Where the
rarest words of a window stand close to each other, in any order, it is a proximity match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import checked_broadcast, cut, split_words

#: What stands between words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased: words are runs
#: of digits, a-z and anything beyond ASCII.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NULL_KEY = -(1 << 63)
_ID = ["id", "h"]
#: The end of a document is indexed under one of so many marks; they start with a space, as no word does.
_ENDS = 256


def plain_words(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    # in pure ASCII the fast function does just that
    ascii_ = F.octet_length(text) == F.char_length(text)
    return split_words(F.when(ascii_, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), _BETWEEN)


def test_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = 10) -> tuple[DataFrame, DataFrame]:
    """(windows, items): distinct windows (window, terms), and which item has which window.

    A window is ``size`` consecutive words; an item with fewer, but not none, is one window.
    """
    w = benchmark.select(F.col(item).cast("string").alias("item"), plain_words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1))))
    w = w.select("item", "w", starts.alias("s")).select("item", F.slice("w", F.col("s"), size).alias("terms"))
    w = w.withColumn("window", F.sha2(F.array_join("terms", " "), 256))
    return w.select("window", "terms").distinct(), w.select("item", "window").distinct()


def identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, h, text): rows that share a key are told apart by a hash of their text."""
    return docs.select(F.coalesce(docs[key].cast("long"), F.lit(_NULL_KEY)).alias("id"), F.coalesce(F.xxhash64(docs[text]), F.lit(0)).alias("h"), docs[text].alias("text"))


def _term(word: Column) -> Column:
    """A word in the index; words that share a number are told apart when matches are checked."""
    return F.xxhash64(word)


def rare_terms(rows: DataFrame, windows: DataFrame, rarest: int) -> DataFrame:
    """(window, nth, word, term, offset, n_terms): the ``rarest`` positions of each window whose words are
    found least often in ``rows``, rarest first."""
    placed = windows.select("window", F.posexplode("terms").alias("offset", "word")).select("window", "offset", "word")
    vocabulary = cut(placed.select("word").distinct())
    found = rows.select(F.explode(plain_words(F.col("text"))).alias("word")).join(checked_broadcast(vocabulary, 64), "word", "left_semi")
    # at most one row a word of the benchmark
    counts = cut(found.groupBy("word").count())
    placed = placed.join(checked_broadcast(counts, 80), "word", "left").fillna(0, ["count"])
    order = Window.partitionBy("window").orderBy("count", "word", "offset")
    picked = placed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= rarest)
    n_terms = F.count(F.lit(1)).over(Window.partitionBy("window"))
    return picked.select("window", "nth", "word", _term(F.col("word")).alias("term"), "offset", n_terms.alias("n_terms"))


def positional_index(rows: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths): (term, id, h, pos) of every position (from 0) of every word of ``words`` (word)
    in ``rows``, and (id, h, n_words) of every row, from one pass over the texts."""
    marks = words.sparkSession.range(_ENDS).select(F.concat(F.lit(" "), F.col("id").cast("string")).alias("word"))
    mark = F.concat(F.lit(" "), F.pmod(F.xxhash64("id", "h"), F.lit(_ENDS)).cast("string"))
    placed = rows.select("id", "h", F.posexplode(F.concat(plain_words(F.col("text")), F.array(mark))).alias("pos", "word"))
    kept = placed.join(checked_broadcast(cut(words.select("word").distinct().union(marks)), 64), "word", "left_semi")
    kept = cut(kept.select(F.when(~F.col("word").startswith(" "), _term(F.col("word"))).alias("term"), "id", "h", "pos"))
    return kept.where(F.col("term").isNotNull()), kept.where(F.col("term").isNull()).select("id", "h", F.col("pos").cast("long").alias("n_words"))


def exact_matches(rows: DataFrame, index: DataFrame, anchors: DataFrame, windows: DataFrame, rarest: int) -> DataFrame:
    """(id, h, window, start, length) of every occurrence of a window in ``rows``.

    The postings of a window's rarest word, shifted by its offset, are the places where it may start.
    They are intersected with the shifted postings of its next rarest words, one after the other; what
    is left is compared word by word.
    """
    first = checked_broadcast(anchors.where("nth = 1").select("window", "term", "offset", "n_terms"), 64)
    places = index.join(first, "term").select(*_ID, "window", (F.col("pos") - F.col("offset")).alias("start"), "n_terms").where("start >= 0")
    for nth in range(2, rarest + 1):
        further = checked_broadcast(anchors.where(F.col("nth") == nth).select("window", "term", "offset"), 64)
        asked = places.join(further, "window").withColumn("pos", F.col("start") + F.col("offset"))
        agreed = asked.join(index, [*_ID, "term", "pos"], "left_semi")
        places = agreed.select(places.columns).union(places.where(F.col("n_terms") < nth))
    found = cut(places.select(*_ID, "window", "start").distinct().join(windows, "window"))
    texts = rows.join(checked_broadcast(cut(found.select(*_ID).distinct()), 24), _ID, "left_semi").select(*_ID, plain_words(F.col("text")).alias("words"))
    same = F.slice("words", F.col("start") + 1, F.size("terms")) == F.col("terms")
    return texts.dropDuplicates(_ID).join(found, _ID).where(same).select(*_ID, "window", "start", F.size("terms").alias("length"))


def near_matches(index: DataFrame, anchors: DataFrame, chosen: int, within: int = 20) -> DataFrame:
    """(id, h, window): documents where each of a window's ``chosen`` rarest words (all, if it has fewer)
    stands within ``within`` words of one place of the rarest one, in any order.

    Places are cut into stretches of ``within`` words, so a place meets only those of three stretches.
    """
    few = checked_broadcast(anchors.where("nth = 1").select("window", "term", "n_terms"), 64)
    places = index.join(few, "term").select(*_ID, "window", F.col("pos").alias("at"), "n_terms")
    for nth in range(2, chosen + 1):
        further = checked_broadcast(anchors.where(F.col("nth") == nth).select("window", F.col("term").alias("next")), 64)
        asked = places.join(further, "window").withColumn("stretch", F.explode(F.array(*[F.floor(F.col("at") / within) + d for d in (-1, 0, 1)])))
        met = index.select(*_ID, F.col("term").alias("next"), F.floor(F.col("pos") / within).alias("stretch"), "pos")
        # a stretch holds no more than ``within`` places
        met = met.groupBy(*_ID, "next", "stretch").agg(F.collect_set("pos").alias("spots"))
        close = asked.join(met, [*_ID, "next", "stretch"]).where(F.exists("spots", lambda p: F.abs(p - F.col("at")) <= within))
        places = close.select(places.columns).distinct().union(places.where(F.col("n_terms") < nth))
    return places.select(*_ID, "window").distinct()


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = 10,
    rarest: int = 2,
    chosen: int = 3,
    within: int = 20,
) -> DataFrame:
    """(key, n_words, n_hit, n_items, items, near_items, contaminated) for every row of ``docs``; ``key`` is
    an integer.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Windows are ``size`` consecutive
    words of an item, or a whole item with fewer words.  ``n_hit`` counts the words of the document that
    lie inside an occurrence of a window, ``items`` lists the items with windows there (as strings, in
    code-point order).  ``near_items`` lists the items with a window whose ``chosen`` rarest words stand
    within ``within`` words of one place of the rarest one; rarer is less often in all of ``docs``, ties by
    word and then by place in the window.  ``contaminated`` regards exact occurrences alone.

    The ``rarest`` words of a window are intersected.  Every document, word and window counts; word
    frequencies are those of the whole input.

    Null and empty texts have no words and no hits; items without words, or null, have no windows.  A very
    long text is a row like any other; its words are in memory once while it is split.  Repeated rows get
    equal answers; rows that share a key, or have none, but differ in text are judged apart.  Empty tables
    give empty results or no hits.  Other columns of either table are not read.
    """
    rows = identified(docs, key, text)
    windows, items = test_windows(benchmark, item, item_text, size)
    windows, items = cut(windows), cut(items)
    anchors = cut(rare_terms(rows, windows, max(rarest, chosen)))
    index, lengths = positional_index(rows, anchors)
    hits = cut(exact_matches(rows, index, anchors, windows, rarest))
    covered = hits.select(*_ID, F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("pos")).distinct()
    covered = covered.groupBy(*_ID).agg(F.count(F.lit(1)).alias("n_hit"))

    def listed(found: DataFrame, name: str) -> DataFrame:
        """Items of each document; no list is longer than the benchmark."""
        named = found.join(checked_broadcast(items, 96), "window").select(*_ID, "item").distinct()
        return named.groupBy(*_ID).agg(F.array_sort(F.collect_list("item")).alias(name))

    exact = listed(hits.select(*_ID, "window").distinct(), "items")
    near = listed(near_matches(index, anchors, chosen, within), "near_items")
    found = covered.join(exact, _ID).join(near, _ID, "full")
    out = lengths.join(found, _ID, "left")
    back = F.when(F.col("id") != _NULL_KEY, F.col("id")).cast(docs.schema[key].dataType)
    none = F.array().cast("array<string>")
    return out.select(
        back.alias(key),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
