"""Quality rules: boosted trees over document statistics behind two fixed rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import boosting
from millrace.llm.common import checked_broadcast, cut
from millrace.llm.docstats import COUNTS, FEATURES, scored_statistics, statistics
from millrace.llm.wordhash import slices

#: Labelled documents that the trees are fitted on, at most; those with the smallest key hashes.
TRAIN_ROWS = 20_000
#: Features that may only lower the verdict as they rise.
FALLING = ("symbols_per_word", "dup_line_share", "repeat_word_share", "shouts_per_word", "one_byte_word_share")
DIRECTION = np.array([-1 if f in FALLING else 0 for f in FEATURES])
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30


def fit_rules(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> boosting.Trees | None:
    """Trees for the probability of label 1 from at most ``train_rows`` labelled documents; None if
    there are none."""
    known = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("label")).na.drop()
    known = known.groupBy("key").agg(F.max("label").alias("label"))
    known = cut(known.orderBy(F.xxhash64("key"), "key").limit(train_rows))
    picked = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(checked_broadcast(known, 16).select("key"), "key", "left_semi")
    stats = scored_statistics(picked, "key", "text").dropDuplicates(["key"]).join(known, "key")
    rows = stats.select("key", "features", "label").orderBy("key").collect()  # train_rows rows at most
    if not rows:
        return None
    return boosting.fit(np.array([r.features for r in rows]), np.array([r.label for r in rows], float), DIRECTION)


def apply_rules(docs: DataFrame, trees: boosting.Trees | None, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed, kept) for
    every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``.  ``base_failed``: fewer than ``MIN_WORDS`` words, or more than
    ``MAX_REPEAT_PERCENT`` percent of them in 8-word windows found twice or more in the text.  ``kept`` is
    false then, else whether the trees score at least ``threshold`` (without trees, true).

    Null and empty texts count 0 throughout and fail.  Repeated rows get equal answers.  An empty table
    gives an empty result; other columns are not read.
    """

    def score(features: np.ndarray) -> np.ndarray:
        return np.ones(len(features)) if trees is None else trees.probability(features)

    out = scored_statistics(docs, key, text, score)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    return out.select(key, *COUNTS, "score", failed.alias("base_failed"), (~failed & (F.col("score") >= threshold)).alias("kept"))


def keep_passing(docs: DataFrame, trees: boosting.Trees | None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that ``apply_rules`` keeps.  Rows are judged where they are read;
    nothing is shuffled or joined."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(place)):
                counts, features = statistics(part)
                n_words, n_repeat = counts[:, COUNTS.index("n_words")], counts[:, COUNTS.index("n_repeat_words")]
                keep = (n_words >= MIN_WORDS) & (n_repeat * 100 <= n_words * MAX_REPEAT_PERCENT)
                if trees is not None:
                    keep &= trees.probability(features) >= threshold
                yield batch.slice(first, len(part)).filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
