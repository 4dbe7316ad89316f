import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import recompress
from millrace.llm.repeats import drop_repeats
from millrace.llm.wordhash import window_hash, window_starts, words


def brute_force(rows, window):
    low = -(1 << 63)
    order = sorted({(low if i is None else i, t) for i, t in rows}, key=lambda x: x[0])
    seen, out = set(), {}
    for i, text in order:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return sorted(((i, *out[low if i is None else i]) for i, _ in rows), key=str)


@pytest.mark.parametrize("window", [20, 5])
def test_equals_brute_force(docs, small, window):
    got = sorted((tuple(r) for r in drop_repeats(docs, window=window).collect()), key=str)
    assert got == brute_force([(i, t) for i, t, _ in small], window)


@pytest.mark.parametrize("ids", [(None, None, None, None), (3, 3, 3, 3), (None, 3, None, 3), (5, 3, 3, 7)])
def test_texts_that_share_an_id_are_told_apart(spark, ids):
    """Under one id or none: a text with a shared passage, a short one, a copy of an earlier document, a unique one."""
    passage = " ".join(f"p{k}" for k in range(30))
    first = " ".join(f"f{k}" for k in range(40)) + " " + passage
    texts = [first, "a b c", passage + " " + " ".join(f"t{k}" for k in range(25)), " ".join(f"u{k}" for k in range(60))]
    rows = [(1, first), *zip(ids, texts, strict=True), (ids[3], texts[3]), (9, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = df.distinct().orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()
    seen, out = set(), {}
    for i, text in order:
        w = text.split()
        gone = set()
        for k in range(len(w) - 4):
            key = tuple(w[k : k + 5])
            if key in seen:
                gone |= set(range(k, k + 5))
            seen.add(key)
        out[i, text] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    got = sorted((tuple(r) for r in drop_repeats(df, window=5).collect()), key=str)
    assert got == sorted(((i, *out[i, t]) for i, t in rows), key=str)


def test_empty(nothing):
    assert drop_repeats(nothing).collect() == []


def test_equal_windows_have_equal_anchors(small):
    w = words(pa.array([t or "" for _, t, _ in small]))
    symbols, place = recompress.lay_out(w.hash, w.first)
    fits = window_starts(w.first, 12)
    at = place[fits]
    name, start = recompress.anchors(recompress.levels(symbols), at, 12)
    full = window_hash(w.hash, 12)[fits[: len(w.hash) - 11]]
    seen = {}
    for f, n, offset in zip(full.tolist(), name.tolist(), (start - at).tolist(), strict=True):
        assert seen.setdefault(f, (n, offset)) == (n, offset)
    assert len(np.unique(name)) < len(at)


def test_runs_become_one_symbol():
    h = np.full(64, 7, np.uint64)
    symbols, _ = recompress.lay_out(h, np.array([0, 64]))
    assert len(recompress.run_round(symbols).name) == 3  # border, run, border
