"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary.  The probability of a
word is the sum over all ways to cut it into pieces, by the forward algorithm; that of a text is the
product over its words.  Piece probabilities are learned by expectation-maximisation on word counts of
the whole corpus: expected uses of a piece, over all segmentations, become its new probability.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut
from millrace.llm.wordhash import _LOWER, BASE, INVERSE, mix, powers, slices, span_hash, words

#: Up to so many bytes products of probabilities stay in the range of a double; longer words are summed
#: in logarithms.
SHORT_BYTES = 24
#: Bytes of padded words in one lattice; a longer word is a lattice of its own.
CELLS = 400_000
#: Share of a uniform distribution over pieces in every language, so that nothing has probability 0.
SMOOTH = 1e-4


@lru_cache(maxsize=2)
def _pieces(path: str) -> list[bytes]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        listed = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    else:
        with open(path, encoding="utf-8") as f:
            listed = list(json.load(f)["model"]["vocab"])
    plain = {p.replace("▁", "").replace("</w>", "").replace("Ġ", "").lower().encode() for p in listed}
    return [bytes([b]) for b in range(256)] + sorted(p for p in plain if len(p) > 1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, id) of the pieces, sorted by hash.  Ids 0 to 255 are single bytes, so every word can be cut.

    ``path`` is a tokenizers .json or a sentencepiece .model file.  Pieces are taken in lower case and
    without their mark of a word's start or end.
    """
    pieces = _pieces(path)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    end = np.cumsum([len(p) for p in pieces])
    h = span_hash(data, end - np.array([len(p) for p in pieces]), end)
    order = np.argsort(h)
    return h[order], order


@lru_cache(maxsize=2)
def _by_size(path: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(bytes, hash, id) of the vocabulary for each length of a piece."""
    h, ids = vocabulary(path)
    size = np.array([len(p) for p in _pieces(path)])[ids]
    return [(int(n), h[size == n], ids[size == n]) for n in np.unique(size)]


class Lattice:
    """Distinct words with the vocabulary's pieces at every place."""

    def __init__(self, texts: list[bytes], path: str):
        self.n_pieces = len(vocabulary(path)[1])
        self.length = np.array([len(t) for t in texts], np.int64)
        self.width = int(self.length.max(initial=0))
        data = np.frombuffer(b"".join(texts), np.uint8)
        first = np.cumsum(self.length) - self.length
        row = np.repeat(np.arange(len(texts)), self.length)
        left = (first + self.length)[row] - np.arange(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=total[1:])
        back = powers(INVERSE, len(data) + 1)
        #: (bytes, words, ids, from, to) of the pieces of a length, by the byte behind which they end
        self.piece: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for size, h, ids in _by_size(path):
            at = np.flatnonzero(left >= size)
            if not len(at):
                break
            found = mix((total[at + size] - total[at]) * back[at] + np.array([size], np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            k = np.minimum(np.searchsorted(h, found), len(h) - 1)
            ok = h[k] == found
            at, k = at[ok], k[ok]
            end = at - first[row[at]] + size
            order = np.argsort(end, kind="stable")
            if len(order):
                self.piece.append((size, row[at][order], ids[k][order], np.searchsorted(end[order], np.arange(self.width + 2))))

    def _ending(self, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bytes, words, ids) of the pieces that end behind byte ``end``."""
        for size, rows, ids, bound in self.piece:
            if size > end:
                break
            a, b = bound[end], bound[end + 1]
            if a < b:
                yield size, rows[a:b], ids[a:b]

    @property
    def short(self) -> bool:
        return self.width <= SHORT_BYTES

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[i, word, language]: summed probability of all segmentations of the first i bytes, with
        ``p`` (pieces, languages); its logarithm if a word is not short."""
        alpha = np.full((self.width + 1, len(self.length), p.shape[1]), 0.0 if self.short else -np.inf)
        alpha[0] = 1.0 if self.short else 0.0
        q = p if self.short else np.log(p)
        for end in range(1, self.width + 1):
            for size, rows, ids in self._ending(end):
                if self.short:
                    alpha[end, rows] += alpha[end - size, rows] * q[ids]
                else:
                    alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[end - size, rows] + q[ids])
        return alpha

    def word_log(self, p: np.ndarray) -> np.ndarray:
        whole = self.forward(p)[self.length, np.arange(len(self.length))]
        return np.log(whole) if self.short else whole

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """(pieces, languages): expected uses of each piece over words with ``weight`` (words, languages).
        A word says nothing about languages where its weight is 0."""
        alpha = self.forward(p)
        last = self.length, np.arange(len(self.length))
        uses = np.zeros((self.n_pieces, p.shape[1]))
        some = weight > 0
        if self.short:
            beta = np.zeros_like(alpha)
            beta[last] = np.divide(weight, alpha[last], out=np.zeros_like(alpha[last]), where=some)
        else:
            beta = np.full_like(alpha, -np.inf)
            beta[last] = np.where(some, np.log(np.where(some, weight, 1.0)) - alpha[last], -np.inf)
        q = p if self.short else np.log(p)
        for end in range(self.width, 0, -1):
            for size, rows, ids in self._ending(end):
                if self.short:
                    passed = beta[end, rows] * q[ids]
                    beta[end - size, rows] += passed
                    np.add.at(uses, ids, passed * alpha[end - size, rows])
                else:
                    passed = beta[end, rows] + q[ids]
                    beta[end - size, rows] = np.logaddexp(beta[end - size, rows], passed)
                    np.add.at(uses, ids, np.exp(passed + alpha[end - size, rows]))
        return uses


def lattices(texts: list[bytes], path: str) -> Iterator[tuple[np.ndarray, Lattice]]:
    """(numbers, lattice) of all words, those of about the same length together, short ones apart."""
    length = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(length, kind="stable")
    length = length[order]
    a = 0
    while a < len(order):
        stop = int(np.searchsorted(length, SHORT_BYTES, "right")) if length[a] <= SHORT_BYTES else len(order)
        fits = np.flatnonzero(length[a:stop] * np.arange(1, stop - a + 1) > CELLS)
        b = a + max(1, int(fits[0])) if len(fits) else stop
        yield order[a:b], Lattice([texts[i] for i in order[a:b]], path)
        a = b


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def letter_words(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(data, start, end, text) of lower-cased runs of letters, of any length.

    Letters are those of ASCII and all characters beyond it; A-Z are lower-cased, and so are the
    capitals of U+00C0 to U+00DE.
    """
    w = words(part)
    data = _LOWER[w.data]
    lead = np.zeros(len(data), bool)
    lead[1:] = data[:-1] == 0xC3
    capital = lead & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    data[capital] += 0x20
    letter = _ASCII_LETTER[data] | (data >= 0x80)
    edge = np.zeros(len(data) + 1, bool)
    edge[w.text_at] = True
    before = np.zeros(len(data), bool)
    before[1:] = letter[:-1]
    start = np.flatnonzero(letter & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = letter[1:]
    end = np.flatnonzero(letter & (~after | edge[1:])) + 1
    return data, start, end, np.searchsorted(w.text_at, start, "right") - 1


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each slice of (lang, text)."""
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        for first, part in slices(batch.column(1)):
            data, start, end, doc = letter_words(part)
            lang = code[first : first + len(part)][doc].astype(np.uint64)
            h = span_hash(data, start, end)
            _, one, n = np.unique(h * np.uint64(0x9E3779B97F4A7C15) + lang, return_index=True, return_counts=True)
            raw = data.tobytes()
            word = [raw[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[int(k)] for k in lang[one]], pa.string()), pa.array(word, pa.binary()), pa.array(n.astype(np.int64))], ["lang", "word", "n"]
            )


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def learn_pieces(counts: DataFrame, langs: list[str], path: str, rounds: int = 3) -> np.ndarray:
    """(pieces, languages): piece probabilities by expectation-maximisation over (lang, word, n) rows.

    Every word counts in every round.  What reaches the driver is one number a piece and language.
    """
    column = {lang: i for i, lang in enumerate(langs)}
    n_pieces = len(vocabulary(path)[1])
    p = np.full((n_pieces, len(langs)), 1.0 / n_pieces)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], p: np.ndarray = p) -> Iterator[pa.RecordBatch]:
            total = np.zeros(p.shape)
            for block in _blocks(batches):
                code = np.array([column[x] for x in block.column(0).to_pylist()], np.int64)
                weight = np.zeros((block.num_rows, len(langs)))
                weight[np.arange(block.num_rows), code] = block.column(2).to_numpy()
                for some, lattice in lattices(block.column(1).to_pylist(), path):
                    total += lattice.expected(p, weight[some])
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(lang), pa.array(total[piece, lang])], ["piece", "lang", "n"])

        summed = counts.mapInArrow(run, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        uses = np.zeros(p.shape)
        uses[summed["piece"], summed["lang"]] = summed["n"]
        p = (1 - SMOOTH) * uses / np.maximum(uses.sum(0), 1e-300) + SMOOTH / n_pieces
    return p


class _Known:
    """Word scores that a Python worker remembers, by hash, while one model is in use."""

    def __init__(self, width: int):
        self.hash = np.zeros(0, np.uint64)
        self.score = np.zeros((0, width))

    def look_up(self, h: np.ndarray, compute) -> np.ndarray:
        at = np.searchsorted(self.hash, h)
        known = at < len(self.hash)
        known[known] = self.hash[at[known]] == h[known]
        out = np.zeros((len(h), self.score.shape[1]))
        out[known] = self.score[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = compute(new)
            if len(self.hash) + len(new) > 1_000_000:
                self.hash, self.score = h, out
            else:
                self.hash = np.insert(self.hash, at[new], h[new])
                self.score = np.insert(self.score, at[new], out[new], axis=0)
        return out


def identify_language(
    docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", lang: str = "lang", learn_from: Column | None = None, rounds: int = 3
) -> DataFrame:
    """(key, lang_pred, score) for every row of ``docs``.

    Learned from the rows with a text and a language for which ``learn_from`` (a condition on columns of
    ``docs``) holds; all of them, whole texts.  ``path`` is the vocabulary's file, readable on every
    executor.  ``lang_pred`` is the language under which the text is likeliest, ties by name; ``score`` is
    its share of the summed likelihoods, per word, so that it says more than 1 for every long text.

    Null texts, and texts without a letter, are ``und`` with score 0; so is everything if there is
    nothing to learn from.  Repeated rows get equal answers.  An empty table gives an empty result;
    columns other than the named ones (and those of ``learn_from``) are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    known = docs.where(docs[lang].isNotNull() & docs[text].isNotNull())
    if learn_from is not None:
        known = known.where(learn_from)
    counts = known.select(known[lang].alias("lang"), known[text].alias("text")).mapInArrow(_word_counts, "lang string, word binary, n long")
    counts = cut(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())  # one row a language
    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    if not langs:
        return rows.select(F.col("key").alias(key), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    p = learn_pieces(counts, langs, path, rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _Known(len(langs))
        for batch in batches:
            for first, part in slices(batch.column(1)):
                data, start, end, doc = letter_words(part)
                h, one, back = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
                raw = data.tobytes()

                def compute(new: np.ndarray, raw=raw, start=start, end=end, one=one) -> np.ndarray:
                    texts = [raw[a:b] for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist(), strict=True)]
                    out = np.zeros((len(texts), len(langs)))
                    for some, lattice in lattices(texts, path):
                        out[some] = lattice.word_log(p)
                    return out

                each = memory.look_up(h, compute) if len(h) else np.zeros((0, len(langs)))
                n = np.bincount(doc, minlength=len(part))
                total = np.column_stack([np.bincount(doc, each[back, k], len(part)) for k in range(len(langs))])
                mean = total / np.maximum(n, 1)[:, None]
                share = np.exp(mean - mean.max(1, keepdims=True))
                share /= share.sum(1, keepdims=True)
                best = total.argmax(1)
                # runs beyond ASCII may be signs; only texts without ASCII letters need a closer look
                ascii_ = np.bincount(doc[_ASCII_LETTER[data[start]] | _ASCII_LETTER[data[end - 1]]], minlength=len(part)) > 0
                lettered = ascii_ | np.array([not a and bool(m) and _has_letter(part[i].as_py()) for i, (a, m) in enumerate(zip(ascii_, n, strict=True))], bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        pa.array([langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], pa.string()),
                        pa.array(np.where(lettered, share[np.arange(len(part)), best], 0.0)),
                    ],
                    ["key", "lang_pred", "score"],
                )

    out = rows.mapInArrow(run, f"key {kind}, lang_pred string, score double")
    return out.withColumnRenamed("key", key)
