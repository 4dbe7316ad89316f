import pytest
from pyspark.sql import functions as F

from millrace.functions import aggregate as agg
from millrace.operators import change, statistics
from millrace.operators import relational as rel
from millrace.plans import catalogue


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def left(spark):
    return rel.values(spark, [(1, "a"), (2, "b"), (None, "c")], "k int, v string")


@pytest.fixture(scope="module")
def right(spark):
    return rel.values(spark, [(1, "x"), (1, "y"), (3, "z"), (None, "n")], "j int, w string")


def test_joins(left, right):
    on = F.col("k") == F.col("j")
    assert len(rows(rel.join(left, right, on))) == 2
    assert len(rows(rel.join(left, right, on, "left"))) == 4
    assert len(rows(rel.join(left, right, on & (F.col("w") == "x"), "right"))) == 4
    assert len(rows(rel.join(left, right, kind="cross"))) == 12
    assert len(rows(rel.join(left, right, F.col("k") < F.col("j")))) == 2
    with pytest.raises(ValueError):
        rel.join(left, right, on, "full")


@pytest.mark.parametrize(("bits", "n"), [(0, 1024), (2, 3), (16, 1), (16, 1024)])
def test_join_lists(spark, left, right, monkeypatch, bits, n):
    monkeypatch.setattr(rel, "BLOCK_BITS", bits)
    monkeypatch.setattr(rel, "LIST_ROWS", n)
    more = right.union(right).union(rel.values(spark, [(1, None), (2, None)], "j int, w string"))
    wide = left.union(left).withColumn("u", F.length("v"))
    for kind in ("inner", "left"):
        on = F.col("k") == F.col("j")
        assert rows(rel.join_lists(left, more, "k", "j", kind)) == rows(rel.join(left, more, on, kind).select("v", "w"))
        two = more.withColumn("x", F.length("w"))
        assert rows(rel.join_lists(wide, two, "k", "j", kind)) == rows(rel.join(wide, two, on, kind).select("v", "u", "w", "x"))
        assert rows(rel.join_lists(left, more.where("1 = 0"), "k", "j", kind)) == ([("a", None), ("b", None), ("c", None)] if kind == "left" else [])
        assert rows(rel.join_lists(left.where("1 = 0"), more, "k", "j", kind)) == []
    with pytest.raises(ValueError):
        rel.join_lists(left, more, "k", "j", "right")


def test_pairs_of_one_key_are_dealt_over_tasks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(rel, "LIST_ROWS", 50, raising=False)
    n = 1000
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit(5).alias("c_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.lit(5).alias("s_nationkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    df = catalogue.QUERIES["join_on_null_keys"](spark, str(tmp_path))
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == n * n
    assert max(counts) < n * n / 4


def test_in_and_not_in(spark, left):
    one, null, none = (rel.values(spark, r, "q int") for r in ([(1,)], [(1,), (None,)], []))
    assert rows(rel.where_in(left, "k", null)) == [(1, "a")]
    assert rows(rel.where_not_in(left, "k", one)) == [(2, "b")]
    assert rows(rel.where_not_in(left, "k", null)) == []
    assert len(rows(rel.where_not_in(left, "k", none))) == 3


def test_exists_and_scalar(spark, left):
    some, none = rel.values(spark, [(5,)], "q int"), rel.values(spark, [], "q int")
    assert len(rows(rel.where_exists(left, some))) == 3
    assert rows(rel.where_exists(left, none)) == []
    assert len(rows(rel.where_exists(left, none, negate=True))) == 3
    assert {r.s for r in rel.with_scalar(left, "s", some).collect()} == {5}
    assert {r.s for r in rel.with_scalar(left, "s", none).collect()} == {None}
    with pytest.raises(Exception, match="more than one row"):
        rel.with_scalar(left, "s", some.union(some)).collect()


def test_unions(spark, left):
    both = left.union(left)
    assert len(rows(rel.union(left, left, left, all_=True))) == 9
    assert len(rows(rel.union(both, left))) == 3
    with pytest.raises(ValueError, match="number of columns"):
        rel.union(left, left.select("k"))


def test_order_and_limit(left):
    assert [r.v for r in rel.sort(left, "k").collect()] == ["c", "a", "b"]
    assert [r.v for r in rel.sort(left, F.col("k").desc()).collect()] == ["b", "a", "c"]
    assert [r.v for r in rel.top_k(left, 1, "k", offset=1).collect()] == ["a"]


def test_empty_aggregate(left):
    nothing = left.where("1 = 0")
    assert rows(rel.aggregate(nothing, {}, {"n": agg.count_all(), "s": agg.total(F.col("k"))})) == [(0, None)]
    assert rows(rel.aggregate(nothing, {"v": "v"}, {"n": agg.count_all()})) == []


def test_changes(spark, left):
    assert rows(change.update(left, {"k": F.col("k") + 10, "v": F.col("k").cast("string")}, F.col("k") > 1)) == [(1, "a"), (12, "2"), (None, "c")]
    assert rows(change.delete(left, F.col("k") > 1)) == [(1, "a"), (None, "c")]
    assert rows(change.delete(left)) == []
    new = rel.values(spark, [(None, "d"), (0, "e"), (9, "f")], "k int, v string")
    got = dict((v, k) for k, v in rows(change.insert(left, new, auto="k")))
    assert got["f"] == 9 and {got["d"], got["e"]} == {3, 4}
    with pytest.raises(change.DuplicateKey):
        change.insert(left, rel.values(spark, [(1, "z")], "k int, v string"), [["k"]])
    assert len(rows(change.insert(left, rel.values(spark, [(None, "z")], "k int, v string"), [["k"]]))) == 4
    assert change.add_column(left, "m", "int", after="k").columns == ["k", "m", "v"]
    assert change.drop_column(left, "v").columns == ["k"]


def test_partner_of_an_update_is_the_smallest(spark, left, right):
    for rows_ in (right, right.orderBy(F.col("w").desc()).repartition(3)):
        got = change.update_join(left, rows_.withColumnRenamed("j", "k"), ["k"], {"v": F.col("o_w")})
        assert rows(got) == [(1, "x"), (2, "b"), (None, "c")]


def test_numbers_are_given_once(spark):
    old = rel.values(spark, [(7, "a")], "k int, v string")
    new = spark.range(200).repartition(5).select(F.when(F.col("id") % 10 == 0, F.col("id") + 1000).cast("int").alias("k"), F.col("id").cast("string").alias("v"))
    got = change.insert(old, new, [["k"]], auto="k").collect()
    assert sorted(r.k for r in got if r.k < 1000) == [7, *range(8, 188)]


@pytest.mark.parametrize("buckets", [10, 256])
def test_histogram(spark, buckets):
    values = sorted([k % 100 for k in range(1000)] + [7] * 3000)
    df = rel.values(spark, [(v,) for v in values] + [(None,)], "v int").repartition(5)
    want = {}
    for v in sorted(set(values)):
        last = max(k for k, x in enumerate(values) if x == v)
        want.setdefault(last * buckets // len(values), []).append(v)
    want = sorted((b, min(vs), max(vs), sum(map(values.count, vs)), values.count(max(vs)), len(vs)) for b, vs in want.items())
    assert sorted(tuple(r) for r in statistics.histogram(df, "v", buckets).collect()) == want
