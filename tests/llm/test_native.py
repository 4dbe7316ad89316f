"""Sharding, mixing, decontamination and URL filters against brute force."""

import datetime
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import decontaminate as d
from millrace.llm.common import word_count
from millrace.llm.mixing import clean_text_weight, mix_sources
from millrace.llm.sharding import assign_shards, jump_hash
from millrace.llm.urlfilter import filter_urls, url_keys


def test_shards(docs, small):
    got = assign_shards(docs, shards=4, buckets=8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in small)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 4 and r.grown_shard in (r.shard, 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_key = defaultdict(set)
    for r in got:
        by_key[r.doc_id].add(r.shard)
    assert all(len(s) == 1 for s in by_key.values())


def walked(spark, keys, shards):
    """The jump walk with xxhash64(key, step) as its draws, one key at a time, as the paper gives it."""
    drawn = {r.k: r.d for r in spark.createDataFrame([(k,) for k in keys], "k long").select("k", F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.xxhash64("k", i)).alias("d")).collect()}
    out = {}
    for k, draws in drawn.items():
        at, onward = -1, 0
        for d in draws:
            if onward >= shards:
                break
            at = onward
            onward = math.floor((at + 1) * (float(1 << 31) / ((d % (1 << 64) >> 33) + 1)))
        out[k] = at
    return out


@pytest.mark.parametrize("shards", [1, 2, 8, 9, 500])
def test_jump_walk(spark, shards):
    keys = [None, *range(-50, 400), 2**62]
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_hash(F.col("k"), shards).alias("s")).collect()
    assert {r.k: r.s for r in got} == walked(spark, keys, shards)


def test_a_walk_beyond_the_usual_steps(spark, monkeypatch):
    keys = list(range(300))
    want = walked(spark, keys, 64)
    monkeypatch.setattr("millrace.llm.sharding.min", lambda *a: 2, raising=False)
    got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_hash(F.col("k"), 64).alias("s")).collect()
    assert {r.k: r.s for r in got} == want


def test_shards_of_equal_rows(spark):
    """One key with many texts, and rows equal in both, take gapless slots; the order hangs on the rows alone."""
    rows = [(None, f"t{k}") for k in range(300)] + [(7, "same")] * 500 + [(7, None), (7, ""), (8, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [assign_shards(df.repartition(n), shards=3, buckets=b, chunk=64).collect() for n, b in ((1, 8), (5, 8), (2, None))]
    assert Counter(runs[0]) == Counter(runs[1])
    for got in runs:
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        for shard in {r.shard for r in got}:
            slots = sorted(r.slot for r in got if r.shard == shard)
            assert slots == list(range(len(slots)))


def test_shards_of_nothing(nothing):
    assert assign_shards(nothing).collect() == []


def test_jump_hash_is_even_and_moves_little(spark):
    keys = spark.range(20000)
    moved = keys.select(*[jump_hash(F.col("id"), n).alias(f"s{n}") for n in (1, 8, 9, 30)])
    rows = moved.collect()
    assert {r.s1 for r in rows} == {0}
    for n in (8, 30):
        counts = Counter(r[f"s{n}"] for r in rows)
        assert len(counts) == n and max(counts.values()) < 1.3 * 20000 / n
    away = [r for r in rows if r.s8 != r.s9]
    assert all(r.s9 == 8 for r in away) and 0.8 < len(away) * 9 / 20000 < 1.2


def targets(rows, share=1.5, cap=2.0):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, out, open_ = share * sum(sizes.values()), {}, set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > cap * sizes[s]}
        if not full:
            return sizes, out | {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return sizes, out


def level(want, sized, cap=2.0):
    """c with sum of size * min(c * w, cap) = want, by halving."""
    low, high = 0.0, 1e9
    if want >= cap * sum(s for s, _ in sized) * (1 - 1e-12):
        return math.inf
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(s * min(c * w, cap) for s, w in sized) < want else (low, c)
    return low


def pareto(rows, want, cap=2.0):
    """Copies of each (key, draw) by plain order sampling: in order of rank whatever still fits."""
    taken = defaultdict(list)
    for source, target in want.items():
        own = [r for r in rows if r.source == source]
        c = level(target, [(r.size, r.w) for r in own], cap)
        room, ranked = target, []
        for r in own:
            expected = min(c * r.w, cap) if r.w else 0.0
            whole = math.floor(expected)
            room -= r.size * whole
            p = expected - whole
            u = ((r.draw % (1 << 64) >> 11) + 0.5) / (1 << 53)
            ranked.append(((u / (1 - u) * (1 - p) / p) if p > 0 else math.inf, r, whole))
        for rank, r, whole in sorted(ranked, key=lambda x: (x[0], x[1].draw, x[1].key or -1)):
            fits = rank < math.inf and r.size <= room
            room -= r.size * fits
            taken[r.key, r.size].append(whole + fits)
        assert room >= -1e-3
    return {k: sorted(v) for k, v in taken.items()}


@pytest.mark.parametrize("weight, buckets", [(None, 16), ("clean", 16), ("chars", 3), ("odd", None)])
def test_mix(docs, small, weight, buckets):
    w = {None: None, "clean": clean_text_weight(F.col("text")), "chars": F.col("n_chars"), "odd": F.when(F.col("doc_id") % 3 == 0, float("nan")).when(F.col("doc_id") % 3 == 1, 1e-9)}[weight]
    got = mix_sources(docs, weight=w, buckets=buckets).collect()
    again = mix_sources(docs.repartition(2), weight=w, buckets=buckets).collect()
    assert Counter(got) == Counter(again)
    sizes, want = targets(small)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in small)
    for r in got:
        source = next(s for s in want if sizes[s] == r.source_size)
        assert r.target == pytest.approx(want[source]) and r.taken == r.copies * r.size <= 2 * r.size
    seen = F.lit(1.0) if w is None else F.greatest(F.least(F.coalesce(F.nanvl(w.cast("double"), F.lit(1.0)), F.lit(1.0)), F.lit(1e6)), F.lit(1e-6))
    facts = docs.select(F.col("doc_id").alias("key"), word_count(F.col("text")).alias("size"), "source", seen.alias("w"), F.xxhash64("doc_id", "text", F.lit(17)).alias("draw")).collect()
    mine = defaultdict(list)
    for r in got:
        mine[r.doc_id, r.size].append(r.copies)
    assert {k: sorted(v) for k, v in mine.items()} == pareto(facts, want)
    assert len({r.copies for r in got}) > 1


def test_weighted_targets_are_met(spark):
    """One text of each source may be missing at most, though the heaviest documents are cut off at twice."""
    rows = [(k, "w " * (1 + k % 40 + k % 3), f"s{k % 3}", 1.0 + 50 * (k % 11 == 0)) for k in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, weight double")
    got = mix_sources(table, weight=F.col("weight")).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert len(target) == 3 and all(0 <= target[s] - taken[s] <= 3 for s in target)
    heavy = [r for r in got if r.doc_id % 11 == 0]
    assert sum(r.copies == 2 for r in heavy) > 0.9 * len(heavy)


def test_mix_of_nothing(nothing):
    assert mix_sources(nothing).collect() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def hits(docs, items, size):
    windows = defaultdict(set)
    for i, text in items:
        w = plain(text)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[k : k + size])].add(str(i))
    lengths = {len(x) for x in windows}
    for i, text in docs:
        w, hit, found = plain(text), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if x := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= x
        yield i, len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def benchmark(spark, small):
    long_ = [t for _, t, _ in small if t and len(t.split()) > 60]
    items = [(1, " ".join(long_[0].split()[5:30])), (2, long_[1].upper()), (3, "three words"), (4, None), (5, "?!"), (6, "THREE, words!"), (7, "not in any text at all of these")]
    items += [(8, " ".join(long_[2].split()[10:22]) + " É"), (9, "A a"), (10, "nowhere")]
    return items, spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id bigint, text string, id string, window string")


@pytest.mark.parametrize("rarest", [1, 3])
def test_decontaminate(docs, small, benchmark, rarest):
    items, table = benchmark
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in d.decontaminate(docs, table, rarest=rarest).collect()), key=str)
    assert got == sorted(hits([(i, t) for i, t, _ in small], items, 10), key=str)
    assert sum(x[2] > 0 for x in got) > 5


def test_decontaminate_nothing(docs, small, nothing, benchmark):
    _, table = benchmark
    assert d.decontaminate(nothing, table).collect() == []
    clean = d.decontaminate(docs, table.limit(0)).collect()
    assert len(clean) == len(small) and not any(r.contaminated or r.n_items for r in clean)


def near(docs, items, size, chosen, within):
    """Items with a window whose rarest words stand close to one place of the rarest, per document."""
    counts = Counter(x for _, t in docs for x in plain(t))
    windows = defaultdict(set)
    for i, text in items:
        w = plain(text)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows[tuple(w[k : k + size])].add(str(i))
    picked = {x: [w for _, w, _ in sorted((counts[w], w.encode(), k) for k, w in enumerate(x))[:chosen]] for x in windows}
    for i, text in docs:
        places = defaultdict(list)
        for k, x in enumerate(plain(text)):
            places[x.encode()].append(k)
        found = set()
        for x, (first, *others) in picked.items():
            if any(all(any(abs(p - at) <= within for p in places[o]) for o in others) for at in places[first]):
                found |= windows[x]
        yield i, sorted(found)


@pytest.mark.parametrize("chosen, within", [(3, 20), (4, 6), (1, 5)])
def test_near_matches(spark, docs, small, benchmark, chosen, within):
    items, table = benchmark
    got = sorted(((r.doc_id, list(r.near_items)) for r in d.decontaminate(docs, table, chosen=chosen, within=within).collect()), key=str)
    want = sorted(near([(i, t) for i, t, _ in small], items, 10, chosen, within), key=str)
    assert got == want and sum(bool(x) for _, x in want) > 5


def test_near_matches_in_any_order(spark):
    texts = [(1, "x alpha filler beta y"), (2, "beta z z alpha"), (3, "alpha " + "z " * 30 + "beta"), (4, "alpha alone")]
    out = d.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"), within=5)
    assert {r.doc_id for r in out.collect() if r.near_items} == {1, 2}
    assert not any(r.contaminated for r in out.collect())


def moment(day, hour=0):
    return datetime.datetime(2024, 1, day, hour)


def test_url_filter(spark):
    entries = [("bad.com", moment(3), 1), ("bad.com", moment(10), 0), ("bad.com", moment(20), 1), ("good.org/spam", moment(1), 1), ("same.net", moment(5), 0), ("same.net", moment(5), 1), (None, moment(1), 1), ("x.y", None, 1)]
    urls = ["http://bad.com/a", "https://Sub.BAD.com:8080/b?q", "http://notbad.com/", "http://good.org/spam/1", "http://good.org/ham", "http://same.net.", "mailto:x", "", None]
    caps = [(k, u, moment(t, 1)) for k, u in enumerate(urls) for t in (2, 4, 12, 25)] + [(0, urls[0], None), (0, urls[0], moment(3, 0)), (0, urls[0], moment(4, 1))]
    table = spark.createDataFrame([(*c, "x") for c in caps], "page_id long, url string, fetched timestamp, rule string")
    listed = spark.createDataFrame(entries, "key string, at timestamp, listed int")

    def active(key, t):
        last = None
        for k, at, on in sorted((e for e in entries if None not in e), key=lambda e: (e[1], e[2])):
            if k == key and at <= t:
                last = on
        return last == 1

    keys = {u: k for u, k in zip(urls, ([*r.k] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(url_keys(F.col("u")).alias("k")).collect()), strict=True)}
    want = sorted(((p, u, t, sum(active(k, t) for k in keys[u]) if t else 0) for p, u, t in caps), key=str)
    out = filter_urls(table, listed)
    assert sorted(((r.page_id, r.url, r.fetched, r.n_rules) for r in out.collect()), key=str) == want
    assert all(r.blocked == (r.n_rules > 0) == (r.rule is not None) for r in out.collect())
    assert keys["https://Sub.BAD.com:8080/b?q"] == ["sub.bad.com", "bad.com", "sub.bad.com/b"]
    assert sum(w[3] for w in want) >= 8
    assert filter_urls(table.limit(0), listed).collect() == []
    assert not any(r.blocked for r in filter_urls(table, listed.limit(0)).collect())


def own_keys(url):
    rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
    host, *segments = rest.split("/")
    host = host.split("@")[-1].split(":")[0].lower().rstrip(".")
    labels = host.split(".")
    keys = {host} | {".".join(labels[k:]) for k in range(len(labels) - 1)}
    return keys | {host + "/" + "/".join(segments[: k + 1]) for k, x in enumerate(segments) if x}


def test_url_keys_of_any_depth(spark):
    urls = ["http://a.b.c.d.Example.com/x/y/z?q=/no", "https://u@host:1/a//b/#c/d", "http://one.two/", "http://single", "ftp://a.b.c/", "http://p.q?x/y", "http://h.i/" + "/".join(f"s{k}" for k in range(30))]
    got = {r.u: list(r.k) for r in spark.createDataFrame([(u,) for u in urls], "u string").select("u", url_keys(F.col("u")).alias("k")).collect()}
    assert {u: sorted(k) for u, k in got.items()} == {u: sorted(own_keys(u)) for u in urls}
    listed = spark.createDataFrame([(k, moment(1), 1) for k in ("example.com", "h.i/s0/s1/s2", "com", "p.q/x")], "key string, at timestamp, listed int")
    table = spark.createDataFrame([(u, moment(2)) for u in urls], "url string, fetched timestamp")
    assert {r.url: r.rule for r in filter_urls(table, listed).collect() if r.blocked} == {urls[0]: "example.com", urls[-1]: "h.i/s0/s1/s2"}


def test_words_do_not_depend_on_their_neighbours(spark):
    """The lower case of a Greek capital sigma depends on what follows it; A-Z alone are lower-cased."""
    texts = [(1, "x ΑΣ.ΒΕΤΑ y"), (2, "ΑΣ ΒΕΤΑ"), (3, "ΑΣ'ΒΕΤΑ END"), (4, "ας βετα"), (5, "ΒΕΤΑ ΑΣ")]
    items = [(1, "ΑΣ ΒΕΤΑ")]
    got = d.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == sorted(hits(texts, items, 10))
    assert {r.doc_id for r in got if r.contaminated} == {1, 2, 3}
