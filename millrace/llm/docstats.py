"""Document statistics of whole texts, computed with numpy over slices of a text column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.wordhash import buffers, slices, span_hash, window_hash, window_starts, words

#: Whole-number statistics of a text, in this order.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios for models, in this order; all are 0 for texts without words.
FEATURES = [
    "log_words",
    "mean_word_length",
    "symbols_per_word",
    "dup_line_share",
    "repeat_word_share",
    "upper_share",
    "digit_share",
    "shouts_per_word",
    "one_byte_word_share",
    "short_word_share",
    "stops_per_word",
    "commas_per_word",
    "beyond_ascii_share",
    "lines_per_word",
    "capital_word_share",
    "pair_repeat_share",
]
REPEAT_WINDOW = 8


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_LOWER = _table(bytes(range(97, 123)))
_DIGIT = _table(bytes(range(48, 58)))
_SHOUT = _table(b"!?")


def _per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _repeated(h: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(twice, again): values found twice or more in their text, and those that repeat an earlier one."""
    bits = np.uint64(max(1, int(n_docs - 1).bit_length()))
    order = np.argsort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (h >> bits), kind="stable")
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice, again = np.zeros(len(h), bool), np.zeros(len(h), bool)
    twice[order] = same[1:] | same[:-1]
    again[order] = same[:-1]
    return twice, again


def _covered(twice: np.ndarray, valid: np.ndarray, size: int, total: int) -> np.ndarray:
    mark = np.zeros(total + 1, np.int64)
    begin = np.flatnonzero(valid)[twice]
    np.add.at(mark, begin, 1)
    np.add.at(mark, begin + size, -1)
    return np.cumsum(mark)[:total] > 0


def statistics(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts, features) of the texts of a slice without nulls: one row a text."""
    data, at = buffers(part)
    n = len(part)
    w = words(part)
    n_words = np.diff(w.first)
    doc = w.doc
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~_table(b" \t\n\x0b\x0c\r")[data], out=inside[1:])
    word_chars = _per_text(((data & 0xC0) != 0x80), at) - (np.diff(at) - (inside[at[1:]] - inside[at[:-1]]))
    n_symbols = _per_text(_SYMBOL[data], at)

    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    edge[1:] |= data == 10
    start = np.flatnonzero(edge[:-1])
    end = np.append(start[1:], len(data))
    body = end - ((end > start) & (data[end - 1] == 10))
    full = inside[body] > inside[start]
    line_doc = np.searchsorted(at, start, "right") - 1
    _, again = _repeated(span_hash(data, start[full], body[full]), line_doc[full], n)
    n_dup = np.bincount(line_doc[full][again], minlength=n)
    n_lines = np.bincount(line_doc[full], minlength=n)

    def repeats(size: int) -> np.ndarray:
        valid = window_starts(w.first, size)
        h = window_hash(w.hash, size)[valid[: max(0, len(w.hash) - size + 1)]]
        twice, _ = _repeated(h, doc[valid], n)
        return np.bincount(doc[_covered(twice, valid, size, len(w.hash))], minlength=n)

    n_repeat = repeats(REPEAT_WINDOW)
    counts = np.column_stack([n_words, word_chars, n_symbols, n_dup, n_repeat]).astype(np.int64)

    length = w.end - w.start
    per_word = 1.0 / np.maximum(n_words, 1)
    per_char = 1.0 / np.maximum(word_chars, 1)
    upper, lower = _per_text(_UPPER[data], at), _per_text(_LOWER[data], at)
    features = np.column_stack(
        [
            np.log1p(n_words),
            word_chars * per_word,
            n_symbols * per_word,
            n_dup / np.maximum(n_lines, 1),
            n_repeat * per_word,
            upper / np.maximum(upper + lower, 1),
            _per_text(_DIGIT[data], at) * per_char,
            _per_text(_SHOUT[data], at) * per_word,
            np.bincount(doc[length == 1], minlength=n) * per_word,
            np.bincount(doc[length <= 3], minlength=n) * per_word,
            _per_text(data == 46, at) * per_word,
            _per_text(data == 44, at) * per_word,
            _per_text(data >= 0xC0, at) * per_char,
            n_lines * per_word,
            np.bincount(doc[_UPPER[data[w.start]]], minlength=n) * per_word,
            repeats(2) * per_word,
        ]
    )
    features[n_words == 0] = 0
    return counts, features


def scored_statistics(docs: DataFrame, key: str, text: str, score=None) -> DataFrame:
    """(key, counts, features array) for every row; with ``score``, a function from the feature matrix
    to one double a row, (key, counts, score) instead."""
    kind = docs.schema[key].dataType.simpleString()
    last = "features array<double>" if score is None else "score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in slices(batch.column(1)):
                counts, features = statistics(part)
                if score is None:
                    tail = pa.ListArray.from_arrays(np.arange(0, features.size + 1, features.shape[1], dtype=np.int32), pa.array(features.ravel()))
                else:
                    tail = pa.array(np.asarray(score(features), np.float64))
                columns = [batch.column(0).slice(first, len(part)), *(pa.array(c) for c in counts.T), tail]
                yield pa.RecordBatch.from_arrays(columns, ["key", *COUNTS, last.split()[0]])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, {', '.join(f'{c} long' for c in COUNTS)}, {last}")
    return out.withColumnRenamed("key", key)
