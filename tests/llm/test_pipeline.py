import pytest
from helpers import SF, same_rows
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import queries
from millrace.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name]))


def test_stages(spark):
    docs = table(spark, SF, "documents")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns
        assert after.join(before, "doc_id", "left_anti").isEmpty()
        if name == "near_duplicates":
            assert after.groupBy("doc_id").count().where("count > 1").isEmpty()
        if name != "mixing":
            assert 0 < after.count() < before.count() + (name == "decontamination")
        before = after
    assert before.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    out = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert out.count() == before.count()


def test_stages_on_odd_tables(spark, docs, nothing):
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    ids = [r.doc_id for r in kept.select("doc_id").collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and kept.columns == docs.columns
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SF).collect() == [], name


SMALL = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SMALL).repartition(3)


def test_near_duplicates_judge_rows(spark):
    def text(c, n=60):
        return " ".join(f"{c}{k}" for k in range(n))

    near = text("a") + " end"
    rows = [(1, text("a")), (None, near), (None, text("b")), (None, text("b") + " x"), (None, text("c")), (5, near), (5, text("d")), (6, text("e")), (6, text("f")), (6, text("f")), (None, None), (None, text("d"))]
    got = corpus_pipeline.near_duplicates(spark, rows_of(spark, [(*r, "s") for r in rows]), SF).collect()
    found = [(r.doc_id, r.text) for r in got]
    b = [x for x in found if x[1] and x[1].startswith("b0")]
    assert len(b) == 1 and b[0][0] is None
    want = [(1, text("a")), (None, text("c")), (5, text("d")), (6, text("e")), (6, text("f")), (None, None), *b]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_decontamination_judges_rows(spark):
    leak = next(r.text for r in table(spark, SF, "benchmark").orderBy("item_id").collect() if r.text and len(r.text.split()) >= 10)
    rows = [(None, leak), (None, "clean one"), (None, "clean two"), (4, "x " + leak), (4, "clean three"), (4, "clean three")]
    got = corpus_pipeline.decontamination(spark, rows_of(spark, [(*r, "s") for r in rows]), SF).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("4", "clean three"), ("4", "clean three"), ("None", "clean one"), ("None", "clean two")]


def test_mixing_judges_rows(spark):
    words = " w x y z"
    rows = [(None, f"t{k} {s}" + words, s) for k in range(60) for s in ("s1", "s2", "s3")] + [(7, f"u{k} {s}" + words, s) for k in range(60) for s in ("s1", "s2", "s3")]
    rows += [(8, "again and again it is", s) for s in ("s1", "s2", "s3") for _ in range(60)]
    got = corpus_pipeline.mixing(spark, rows_of(spark, rows), SF).groupBy("source").count().collect()
    size = 180  # rows of each source: weights 3, 1, 2 share 1.5 times the whole; s1 is cut off at twice its size
    left = 4.5 * size - 2 * size
    sizes = {r["source"]: r["count"] for r in got}
    assert sizes["s1"] == 2 * size
    assert abs(sizes["s2"] - left / 3) <= 2 and abs(sizes["s3"] - left * 2 / 3) <= 2
