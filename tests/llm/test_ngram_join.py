import functools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import components as star
from millrace.llm import ngram_join as j
from millrace.llm.common import spread_join
from millrace.llm.components import connected_components
from millrace.llm.wordhash import words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, s in enumerate(sets):
        shared = Counter(o for x in s for o in holders[x])
        for o, both in shared.items():
            if 100 * both >= percent * (len(s) + len(sets[o]) - both):
                parent[find(k)] = find(o)
        for x in s:
            holders[x].append(k)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k), i)) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_equals_brute_force(docs, small, n, percent):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.ngram_jaccard_join(docs, n=n, percent=percent).collect()), key=str)
    assert got == sorted(components([(i, t) for i, t, _ in small], n, percent), key=str)


def test_frequent_tokens_lose_no_link(docs, small, monkeypatch):
    """With every shared token taken for frequent, the combinations alone find all links."""
    monkeypatch.setattr(j, "FREQUENT_DF", 2)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.ngram_jaccard_join(docs, n=4, percent=85).collect()), key=str)
    assert got == sorted(components([(i, t) for i, t, _ in small], 4, 85), key=str)


def test_hot_signatures_are_split(docs, small, monkeypatch):
    """Every shared signature handled as a hot one."""
    monkeypatch.setattr(j, "spread_join", functools.partial(spread_join, hot=1))
    monkeypatch.setattr(j, "FREQUENT_DF", 2)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.ngram_jaccard_join(docs, n=5, percent=80).collect()), key=str)
    assert got == sorted(components([(i, t) for i, t, _ in small], 5, 80), key=str)


def test_rows_without_a_key_link_and_shared_keys_do_not(spark):
    def text(c, n=60):
        return [f"{c}{k}" for k in range(n)]

    a, x, y = text("a"), text("x"), text("y")
    middle, far = a[3:], a[6:]  # 60 and 57 words: linked; 60 and 54: not
    rows = [(1, a), (None, middle), (3, far), (5, x), (5, y), (2, y + ["end"]), (7, ["start", *x]), (None, text("b")), (None, text("b")), (None, [])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in j.ngram_jaccard_join(df, n=4, percent=91).collect()), key=str)
    want = [(1, 57, 1), (None, 54, 1), (3, 51, 1), (5, 57, 5), (5, 57, 2), (2, 58, 2), (7, 58, 5), (None, 57, None), (None, 57, None), (None, 0, None)]
    assert got == sorted(want, key=str)


def test_large_groups_of_near_copies(spark):
    """Hundreds of texts that all differ a little, in two groups that share most of their words' tokens."""
    r = random.Random(8)
    words_ = [f"w{k}" for k in range(500)]
    rows = []
    for group in (range(0, 120), range(25, 145)):
        base = [words_[k] for k in group]
        for _ in range(150):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = r.choice(words_)
            rows.append((len(rows), " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in j.ngram_jaccard_join(df, n=4, percent=85).collect())
    assert got == sorted(components(rows, 4, 85))


def test_empty(nothing):
    assert j.ngram_jaccard_join(nothing).collect() == []


def test_prefix_signatures_meet():
    """Any two sets at the threshold share a signature, whichever tokens are frequent."""
    rng = np.random.default_rng(3)
    for trial in range(300):
        size = int(rng.integers(6, 200))
        a = np.unique(rng.integers(0, 2**63, size, np.int64).view(np.uint64))
        b = a.copy()
        drop = int(j.allowed(np.array(len(a)), 85))
        b = np.delete(b, rng.choice(len(b), int(rng.integers(0, drop + 1)), replace=False))
        if len(b) < 6:
            continue
        heavy = a[rng.random(len(a)) < rng.random()]
        marks = []
        for s in (a, b):
            f = np.isin(s, heavy)
            want = int(j.allowed(np.array(len(s)), 85)) + 1
            rare = s[~f][:want]
            mine = set(rare.tolist())
            if len(rare) < want:
                level = max(0, want.bit_length() - 2)
                for at in (level, level + 1):
                    mine |= set(j._pair_signatures(s[f], want - len(rare), at).tolist())
            marks.append(mine)
        assert marks[0] & marks[1], trial


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(4)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 600, np.int64).view(np.uint64)
        sets = [np.unique(rng.choice(pool, int(rng.integers(1, 500)))) for _ in range(2)]
        maps = j.bitmaps(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        assert j.most_common(*maps, *map(len, sets)) >= len(np.intersect1d(*sets))


def test_words_equal_the_pattern(small):
    values = [t or "" for _, t, _ in small]
    w = words(pa.array(values))
    for k, text in enumerate(values):
        mine = [w.data[a:b].tobytes().decode() for a, b in zip(w.start[w.first[k] : w.first[k + 1]], w.end[w.first[k] : w.first[k + 1]], strict=True)]
        assert mine == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 70)] + [(200, 100), (100, 100)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {k: 1 for k in range(1, 71)} | {100: 100, 200: 100}
    assert connected_components(links.limit(0)).collect() == []


@pytest.mark.parametrize("one_task", [0, 100_000])
def test_components_by_joins_and_by_windows(spark, monkeypatch, one_task):
    monkeypatch.setattr(star, "ONE_TASK", one_task)
    links = spark.createDataFrame([(k, 300) for k in range(350, 250, -1)] + [(7, 300), (7, 7), (None, 7), (2, 1), (2, 3), (2, 3)], "a long, b long").repartition(3)
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == dict.fromkeys([7, *range(251, 351)], 7) | dict.fromkeys([1, 2, 3], 1)


def test_rounds_of_few_links_shuffle_nothing(spark):
    # each shuffle and broadcast leaves a thread in the driver for a minute
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long").coalesce(1)
    plan = star._relink(star._relink(edges, True, 4), False, 4)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
