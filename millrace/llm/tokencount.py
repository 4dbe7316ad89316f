"""Token counts of whole texts with a public tokenizer, lengths only."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.wordhash import buffers, slices, span_hash

#: Bytes of text in a batch; one longer text is a batch of its own.
BATCH_BYTES = 2 << 20
#: Pieces whose counts a Python worker remembers (12 bytes each).
KNOWN_PIECES = 2_000_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True
#: What may follow a space at which a text is cut: printable ASCII and lead byte C3 (a Latin-1 letter).
_AFTER = np.zeros(256, bool)
_AFTER[33:127] = True


def safe_pieces(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of pieces of the texts ``data[at[i]:at[i + 1]]`` whose token counts add up.

    A byte-level pre-tokenizer always starts a new word at a space that visible text follows, and at
    one of ``.,;:!?`` behind a letter, whatever surrounds them; cuts are made only there.  Letters are
    those of ASCII and of U+00C0 to U+00FF.  Where a text has no such place it stays whole.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    latin = np.zeros(len(data), bool)  # second byte of a letter of U+00C0 to U+00FF
    latin[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    follows = _AFTER[data]
    follows[:-1] |= latin[1:]
    letter = _LETTER[data] | latin
    cut = edge[:-1].copy()
    cut[:-1] |= (data[:-1] == 32) & follows[1:] & ~edge[1:-1]
    cut[1:] |= _STOP[data[1:]] & letter[:-1]
    start = np.flatnonzero(cut)
    end = np.append(start[1:], len(data))
    return start, end, np.searchsorted(at, start, "right") - 1


def may_be_split(path: str) -> bool:
    """Whether counts of ``safe_pieces`` add up under a tokenizers .json: byte-level words by its usual
    pattern, nothing put in front, nothing normalized, and no added token that takes blanks with it or that
    a cut would go through."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    pre = told.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
    for token in told.get("added_tokens") or []:
        data = np.frombuffer(token["content"].encode(), np.uint8)
        plain &= not any(token.get(k) for k in ("lstrip", "rstrip", "single_word", "normalized")) and len(safe_pieces(data, np.array([0, len(data)]))[0]) == 1
    return bool(plain) and told.get("normalizer") is None


class PieceCounter:
    """Token counts of byte pieces; distinct pieces are encoded once and remembered by hash."""

    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.splits = may_be_split(path)
        self.hash = np.zeros(0, np.uint64)
        self.count = np.zeros(0, np.int32)

    def __call__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h, one, back = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.hash, h)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == h[known]
        count = np.zeros(len(h), np.int32)
        count[known] = self.count[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)]
            count[new] = [len(x) for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]
            if len(self.hash) + len(new) > KNOWN_PIECES:
                self.hash, self.count = h, count
            else:
                self.hash = np.insert(self.hash, at[new], h[new])
                self.count = np.insert(self.count, at[new], count[new])
        return count[back]


@lru_cache(maxsize=2)
def _pieces(path: str) -> PieceCounter:
    return PieceCounter(path)


@lru_cache(maxsize=2)
def _sentences(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _count(path: str, part: pa.Array) -> np.ndarray:
    """Token counts of the texts of ``part``, which has no nulls."""
    data, at = buffers(part)
    total = np.zeros(len(part), np.int64)
    if path.endswith(".model"):
        total[:] = [len(x) for x in _sentences(path).encode(part.to_pylist(), num_threads=1)]
    elif len(data) and not _pieces(path).splits:
        total[:] = [len(x) for x in _pieces(path).model.encode_batch_fast(part.to_pylist(), add_special_tokens=False)]
    elif len(data):
        start, end, owner = safe_pieces(data, at)
        counts = _pieces(path)(data, start, end)
        total[:] = np.bincount(owner, counts, len(part)).astype(np.int64)
    return total


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``tokenizer`` is a file readable on every executor: .json for the tokenizers library or .model for
    sentencepiece.  Texts are split only where the file allows it (``may_be_split``), else encoded whole.  Inside a task, texts are taken in batches of about ``BATCH_BYTES``,
    balanced by bytes rather than rows; .json texts are split at safe boundaries (``safe_pieces``), and
    each distinct piece is encoded once per batch at most.  So a very long text is encoded in short
    pieces, and only lengths leave the task.

    Null and empty texts have 0 bytes and 0 tokens.  Special strings inside a text are handled as the
    library does by default.  Ties, repeated rows and null keys are ordinary rows; an empty table gives
    an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes = np.zeros(batch.num_rows, np.int64)
            n_tokens = np.zeros(batch.num_rows, np.int64)
            for first, part in slices(batch.column(1), BATCH_BYTES):
                n_bytes[first : first + len(part)] = np.diff(buffers(part)[1])
                n_tokens[first : first + len(part)] = _count(tokenizer, part)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n_tokens)], ["key", "n_bytes", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    out = rows.mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
