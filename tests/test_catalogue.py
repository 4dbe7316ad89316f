import pytest
from helpers import SF, same_rows

import __spark_entry__ as driver
from millrace.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, SF), duck.sql(catalogue.ORACLE_SQL[name]))


def test_driver_contract(spark):
    assert driver.entry(spark).count() > 0
    found = driver.queries()
    assert set(catalogue.QUERIES) <= set(found)
    assert set(driver.oracle_sql()) <= set(found)


def explained(spark, name):
    """The formatted plan, which names every pushed filter and column read."""
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution()
    return plan.explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def pushed(plan):
    return [line for line in plan.splitlines() if line.startswith("PushedFilters")]


def test_scan_prunes_and_pushes_down(spark):
    plan = explained(spark, "filter_comparison")
    assert any("GreaterThan(o_totalprice,200000.0)" in p and "EqualTo(o_orderstatus,F)" in p for p in pushed(plan))
    assert all("o_orderdate" not in line for line in plan.splitlines() if line.startswith("ReadSchema"))


def test_bounds_of_between_reach_the_scan(spark):
    (line,) = pushed(explained(spark, "filter_between"))
    assert "GreaterThanOrEqual(o_totalprice,100000.0)" in line and "LessThanOrEqual(o_totalprice,120000.0)" in line and "LessThan(o_orderkey,100)" in line
    (line,) = pushed(explained(spark, "revenue_forecast"))
    assert "GreaterThanOrEqual(l_discount,0.03)" in line and "LessThanOrEqual(l_discount,0.07)" in line


def test_top_k_does_not_sort_everything(spark):
    plan = catalogue.QUERIES["top_k"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
