"""Token counts, document statistics, boosted trees, the PU classifier and language ID."""

import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF
from pyspark.sql import functions as F

from millrace.llm import boosting, docstats, langid, pu, queries, quality_rules, tokencount
from millrace.llm.wordhash import slices

JSON, MODEL = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("piece_bpe_32k.model")


def test_token_counts(docs, small, nothing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokencount.count_tokens(docs, JSON).collect()), key=str)
    want = []
    for i, text, _ in small:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        want.append((i, len((text or "").encode()), n, n > 1024))
    assert got == sorted(want, key=str)
    assert tokencount.count_tokens(nothing, JSON).collect() == []


def test_token_counts_of_odd_texts():
    from tokenizers import Tokenizer

    r, t = random.Random(5), Tokenizer.from_file(JSON)
    bits = ["a", "é", "ü", " ", "  ", "\n", "\t", ".", ",", "!", "?", "'s", "'", "<|endoftext|>", "|", "$", "5", " ", " the", "×", "÷", "“", "中", "😀", "\r\n", ";:", "ß"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(3000)]
    got = np.concatenate([tokencount._count(JSON, part) for _, part in slices(pa.array(texts))])
    assert got.tolist() == [len(x) for x in t.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("change", [{"normalizer": {"type": "Lowercase"}}, {"prefix": True}, {"rstrip": True}])
def test_files_that_do_not_split_safely_are_used_whole(tmp_path, change):
    from tokenizers import Tokenizer

    told = json.load(open(JSON, encoding="utf-8"))
    told["normalizer"] = change.get("normalizer")
    told["pre_tokenizer"]["add_prefix_space"] = change.get("prefix", False)
    if "rstrip" in change:
        told["added_tokens"][0]["rstrip"] = True
    path = str(tmp_path / "changed.json")
    json.dump(told, open(path, "w", encoding="utf-8"))
    assert tokencount.may_be_split(JSON) and not tokencount.may_be_split(path)
    texts = ["Hello World, it's me. A b", "", "no <|endoftext|>  end", " x"]
    want = [len(x) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert tokencount._count(path, pa.array(texts)).tolist() == want


def test_token_counts_with_sentencepiece(docs, small):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = Counter((r.doc_id, r.n_tokens) for r in tokencount.count_tokens(docs, MODEL).collect())
    assert got == Counter((i, len(m.encode(t or ""))) for i, t, _ in small)


def counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in lines
            lines.add(line)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)]


def test_statistics(small):
    texts = [t or "" for _, t, _ in small] + ["x\nx\n\n \nx", "a\n\na\r\na", "\n", "#\n#\n*"]
    got, features = docstats.statistics(pa.array(texts))
    assert got.tolist() == [counts(t) for t in texts]
    assert np.isfinite(features).all() and features.shape[1] == len(docstats.FEATURES)


def test_rules(spark, docs, small, nothing):
    out = quality_rules.apply_rules(docs, None).collect()
    want = []
    for i, t, _ in small:
        c = counts(t)
        want.append((i, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert sorted(((r.doc_id, *(r[c] for c in docstats.COUNTS), r.base_failed) for r in out), key=str) == sorted(want, key=str)
    assert all(r.kept != r.base_failed for r in out)
    kept = quality_rules.keep_passing(docs, None)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)
    assert quality_rules.apply_rules(nothing, None).collect() == []
    labels = spark.createDataFrame([(1, None), (2, None)], "doc_id long, quality int")
    assert quality_rules.fit_rules(docs, labels) is None


def test_trees_keep_their_directions():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 4))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) - x[:, 2] + 0.3 * rng.standard_normal(3000)) > 0.2).astype(float)
    direction = np.array([1, 0, -1, 1])
    trees = boosting.fit(x, y, direction, rounds=40)
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.85
    for f in np.flatnonzero(direction):
        probe = np.repeat(x[:50], 40, 0)
        probe[:, f] = np.tile(np.linspace(-0.1, 1.1, 40), 50)
        steps = np.diff(trees.margin(probe).reshape(50, 40), axis=1) * direction[f]
        assert steps.min() >= -1e-9


def test_rules_agree_with_labels(spark):
    rows = quality_rules.apply_rules(spark.read.parquet(f"{SF}/documents.parquet"), quality_rules.fit_rules(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    verdicts = [(r.kept, labels[r.doc_id]) for r in rows.where("NOT base_failed").collect() if r.doc_id in labels]
    assert np.mean([k == bool(q) for k, q in verdicts]) > 0.9


def test_positive_unlabelled_separates():
    rng = np.random.default_rng(1)
    width = len(docstats.FEATURES)
    good, bad = rng.normal(0, 1, (1500, width)), rng.normal(0, 1, (500, width))
    bad[:, 2] += 4
    x = np.vstack([good, bad])
    positive = np.zeros(len(x), bool)
    positive[:600] = True
    knots = np.quantile(x, pu.KNOTS, axis=0).T
    w = pu.minimise(lambda w: pu.risk(pu.sums(x, positive, knots, w), w, 0.71, 1e-3), np.zeros(1 + knots.size), 30)
    score = pu.sigmoid(pu.steps(x, knots) @ w)
    assert (score[600:1500] > 0.5).mean() > 0.93 and (score[1500:] < 0.5).mean() > 0.8


@pytest.mark.parametrize("prior", [0.5, 0.98])
def test_risk_gradient(prior):
    """Of the risk where that of negatives is above 0, else of the opposite of the risk of negatives."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, len(docstats.FEATURES)))
    positive = x[:, 0] > 0.5
    knots = np.quantile(x, pu.KNOTS, axis=0).T
    w = 0.01 * rng.normal(size=1 + knots.size)
    w[1 : 1 + knots.shape[1]] += prior > 0.9  # scores of positives well above the others

    def at(v):
        return pu.risk(pu.sums(x, positive, knots, v), v, prior, 1e-2)

    value, g, negative = at(w)
    assert (negative < 0) == (prior > 0.9)
    for k in (0, 5, 77):
        e = np.zeros(len(w))
        e[k] = 1e-5
        up, down = at(w + e), at(w - e)
        change = up[0] - down[0] if negative >= 0 else down[2] - up[2]
        assert change / 2e-5 == pytest.approx(g[k], abs=1e-5)


def test_minimum_comes_back_from_a_negative_risk():
    """Corrections raise the risk of negatives again, and the best point of all is returned."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (300, len(docstats.FEATURES)))
    positive = x[:, 0] > 0.3
    knots = np.quantile(x, pu.KNOTS, axis=0).T
    seen = []

    def at(w):
        out = pu.risk(pu.sums(x, positive, knots, w), w, 0.9, 1e-3)
        seen.append(out)
        return out

    w = pu.minimise(at, np.zeros(1 + knots.size), 40)
    assert any(a[2] < 0 <= b[2] for a, b in itertools.pairwise(seen))
    assert at(w)[0] == pytest.approx(min(v for v, _, _ in seen))


def test_best_bin():
    rng = np.random.default_rng(6)
    for prior in (0.2, 0.6, 0.9):
        n = 200_000
        good, bad = rng.beta(5, 2, n), rng.beta(2, 5, n)
        mixed = np.concatenate([good[: int(prior * n)], bad[: n - int(prior * n)]])
        counts = [np.histogram(v, np.linspace(0, 1, 1001))[0] for v in (rng.beta(5, 2, n), mixed)]
        assert prior - 0.06 < pu.best_bin(*counts) <= prior + 0.01
    assert pu.best_bin(np.zeros(10), np.ones(10)) == 0.02


def numpy_scores(spark, docs, positives, passes=24, penalties=(1e-4, 1e-3, 1e-2)):
    """The whole fit over one matrix: order of rows and halves by the hashes of the operator, all else plain."""
    facts = docstats.scored_statistics(docs, "doc_id", "text").select("doc_id", "features")
    place = F.xxhash64("doc_id", "features")
    rows = facts.select("doc_id", "features", place.alias("place"), F.pmod(F.xxhash64(place), F.lit(2)).alias("half")).collect()
    rows.sort(key=lambda r: r.place)
    x, half = np.array([r.features for r in rows]), np.array([r.half for r in rows])
    positive = np.array([r.doc_id in positives for r in rows])
    ordered = np.sort(x, axis=0)
    knots = np.array([[ordered[max(math.ceil(q * len(x)) - 1, 0), f] for q in pu.KNOTS] for f in range(x.shape[1])])
    parts = [(np.vstack([x[(half == h) & positive], x[half == h]]), np.repeat([True, False], [((half == h) & positive).sum(), (half == h).sum()])) for h in (0, 1)]

    def case(k, w):
        px, pp = parts[k]
        return np.concatenate([pu.sums(px[~pp], pp[~pp], knots, w)[: 2 + len(w)], pu.sums(px[pp], pp[pp], knots, w)[2 + len(w) :]])

    def halves(objective):
        return [pu.minimise(lambda w, k=k: objective(case(k, w), w), np.zeros(1 + knots.size), passes) for k in (0, 1)]

    models = halves(lambda t, w: pu.apart(t, w, 1e-2))
    score = np.array([pu.sigmoid(pu.steps(v[None], knots) @ models[1 - h])[0] for v, h in zip(x, half, strict=True)])
    bins = np.minimum((score * 1000).astype(int), 999)
    prior = pu.best_bin(np.bincount(bins[positive], minlength=1000), np.bincount(bins, minlength=1000))

    def unseen(l2):
        return sum(pu.risk(case(1 - k, w), w, prior, 0.0)[0] for k, w in enumerate(halves(lambda t, w: pu.risk(t, w, prior, l2))))

    l2 = min(penalties, key=unseen)
    w = pu.minimise(lambda w: pu.risk(pu.sums(x, positive, knots, w), w, prior, l2), np.zeros(1 + knots.size), passes)
    return {r.doc_id: s for r, s in zip(rows, pu.sigmoid(pu.steps(x, knots) @ w), strict=True)}


def test_quality_query_equals_a_plain_fit(spark):
    """op1 against numpy over the same rows; labels of held-out rows, and all labels 0, change nothing."""
    got = {r.doc_id: r for r in queries.op1_quality_classifier(spark, SF).collect()}
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got}
    positives = {r.doc_id for r in labels.collect() if r.quality == 1 and not held[r.doc_id]}
    want = numpy_scores(spark, docs, positives)
    assert all(abs(got[i].score - want[i]) < 1e-3 and got[i].held_out == held[i] and got[i].predicted == (got[i].score >= 0.3) for i in got)


def test_classifier_on_odd_texts(spark, docs, small, nothing):
    labels = spark.createDataFrame([(k, int(k < 40), 0) for k in range(60)] + [(2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = pu.classify_quality(docs, labels, passes=4).collect()
    assert len(out) == len(small) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    flat = pu.classify_quality(docs, labels.limit(0), prior=0.7).collect()
    assert {r.score for r in flat} == {0.7}
    assert pu.classify_quality(nothing, labels).collect() == []


def segmentations(word, vocab):
    for cuts in itertools.product([0, 1], repeat=max(0, len(word) - 1)):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(word)]
        pieces = [word[a:b] for a, b in itertools.pairwise(at)]
        if all(p in vocab for p in pieces):
            yield pieces


def test_forward_sums_all_segmentations():
    h, ids = langid.vocabulary(MODEL)
    rng = np.random.default_rng(0)
    p = rng.random((len(ids), 2))
    p /= p.sum(0)
    texts = [b"the", b"lesson", b"\xc3\xa9t\xc3\xa9", b"q"]

    def number(piece):
        found = langid.span_hash(np.frombuffer(piece, np.uint8), np.array([0]), np.array([len(piece)]))[0]
        k = int(np.searchsorted(h, found))
        return int(ids[k]) if k < len(h) and h[k] == found else None

    got = langid.Lattice(texts, MODEL).word_log(p)
    uses = langid.Lattice(texts, MODEL).expected(p, np.ones((len(texts), 2)))
    want_uses = np.zeros_like(p)
    for row, word in enumerate(texts):
        vocab = {word[a:b]: n for a in range(len(word)) for b in range(a + 1, len(word) + 1) if (n := number(word[a:b])) is not None}
        total = np.zeros(2)
        parts = []
        for pieces in segmentations(word, vocab):
            numbers = [vocab[x] for x in pieces]
            parts.append((numbers, np.prod(p[numbers], axis=0)))
            total += parts[-1][1]
        assert got[row] == pytest.approx(np.log(total))
        for numbers, weight in parts:
            for n in numbers:
                want_uses[n] += weight / total
    assert np.allclose(uses, want_uses)


def test_language_id(spark, docs, small, nothing):
    known = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.identify_language(known, MODEL, learn_from=known.doc_id % 2 == 0, rounds=2).where("doc_id % 2 = 1").collect()
    truth = {r.doc_id: r.lang for r in known.select("doc_id", "lang").collect()}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in out]) > 0.95
    odd = langid.identify_language(docs, MODEL, rounds=1).collect()
    letters = Counter((i, any(c.isalpha() for c in t or "")) for i, t, _ in small)
    assert Counter((r.doc_id, r.lang_pred != "und") for r in odd) == letters
    assert all((r.score == 0) == (r.lang_pred == "und") and 0 <= r.score <= 1 and not math.isnan(r.score) for r in odd)
    assert langid.identify_language(nothing, MODEL).collect() == []


def test_forward_over_long_runs():
    """Words of any length, and pieces of any length, against plain sums in logarithms."""
    pieces = {x: k for k, x in enumerate(langid._pieces(MODEL))}
    longest = max(pieces, key=len)
    assert len(longest) > 12
    texts = [longest, "မြန်မာဘာသာစကားမြန်မာ".encode(), b"abc" * 700, b"the", ("\u0f40" * 40).encode(), longest * 3]
    p = np.full((len(pieces), 2), 1e-9)
    p[:, 1] = np.linspace(1e-9, 1e-3, len(pieces))
    got, uses = np.zeros((len(texts), 2)), np.zeros_like(p)
    for some, lattice in langid.lattices(texts, MODEL):
        got[some] = lattice.word_log(p)
        uses += lattice.expected(p, np.tile([1.0, 0.0], (len(some), 1)))
    for k, word in enumerate(texts):
        for lang in range(2):
            log = [0.0]
            for end in range(1, len(word) + 1):
                terms = [log[a] + math.log(p[n, lang]) for a in range(max(0, end - len(longest)), end) if (n := pieces.get(word[a:end])) is not None]
                log.append(max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms)))
            assert got[k, lang] == pytest.approx(log[-1])
    size = np.array([len(x) for x in pieces])
    assert np.isfinite(uses).all() and not uses[:, 1].any() and uses[:, 0] @ size == pytest.approx(sum(map(len, texts)))


def test_unseen_characters_spoil_no_language(spark):
    run = "".join(chr(0x1000 + k) for k in range(30))
    rows = [(k, "the cat and the dog sat on the mat", "en") for k in range(5)] + [(9, "der hund und die katze " + run, "de"), (10, "und die katze und der hund", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = langid.identify_language(docs, MODEL, rounds=3).collect()
    assert {r.doc_id: r.lang_pred for r in out} == {i: lang for i, _, lang in rows}
    assert not any(math.isnan(r.score) for r in out)
