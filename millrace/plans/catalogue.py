"""Registered queries of the relational operators, each with its SQL twin.

A query is a function of (spark, sf_dir); ``register`` keeps it together with the SQL that gives the
same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import aggregate as agg
from millrace.functions import scalar as fn
from millrace.operators import change, statistics
from millrace.operators import relational as rel
from millrace.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

col = F.col


def register(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    def keep(build: Callable[[Tables], DataFrame]) -> Query:
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(spark, sf_dir))

        query.__name__, query.__doc__ = build.__name__, build.__doc__
        QUERIES[build.__name__] = query
        if sql is not None:
            ORACLE_SQL[build.__name__] = sql
        return query

    return keep


def ts(text: str):
    return F.lit(text).cast("timestamp_ntz")


# grouping


@register(
    """SELECT l_returnflag, l_linestatus, count(*) AS n,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
       round(avg(l_quantity), 3) AS avg_qty, min(l_extendedprice) AS low, max(l_extendedprice) AS high
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY l_returnflag, l_linestatus"""
)
def pricing_summary(t: Tables) -> DataFrame:
    rows = rel.select(t.lineitem, col("l_shipdate") <= ts("2000-09-02"))
    measures = {
        "n": agg.count_all(),
        "sum_qty": agg.total(col("l_quantity"), 2).cast("double"),
        "sum_price": agg.total(col("l_extendedprice"), 2).cast("double"),
        "avg_qty": F.round(F.avg("l_quantity"), 3),
        "low": agg.minimum(col("l_extendedprice")),
        "high": agg.maximum(col("l_extendedprice")),
    }
    return rel.aggregate(rows, {"l_returnflag": "l_returnflag", "l_linestatus": "l_linestatus"}, measures)


@register(
    """SELECT count(*) AS n, count(nullif(o_orderstatus, 'F')) AS n_open, count(DISTINCT o_custkey) AS n_customers,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, left(CAST(min(o_orderdate) AS VARCHAR), 10) AS first_day FROM orders"""
)
def global_aggregate(t: Tables) -> DataFrame:
    measures = {
        "n": agg.count_all(),
        "n_open": agg.count(fn.nullif(col("o_orderstatus"), F.lit("F"))),
        "n_customers": agg.count(col("o_custkey"), distinct=True),
        "total": agg.total(col("o_totalprice"), 2).cast("double"),
        "first_day": F.left(fn.text_of_time(agg.minimum(col("o_orderdate"))), F.lit(10)),
    }
    return rel.aggregate(t.orders, {}, measures)


@register("SELECT count(*) AS n, sum(o_custkey)::DOUBLE AS s, min(o_custkey) AS low FROM orders WHERE o_totalprice < 0")
def aggregate_of_nothing(t: Tables) -> DataFrame:
    rows = rel.select(t.orders, col("o_totalprice") < 0)
    return rel.aggregate(rows, {}, {"n": agg.count_all(), "s": agg.total(col("o_custkey")).cast("double"), "low": agg.minimum(col("o_custkey"))})


@register("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2")
def group_by_expression(t: Tables) -> DataFrame:
    return rel.aggregate(t.orders, {"y": fn.year(col("o_orderdate")), "m": fn.month(col("o_orderdate"))}, {"n": agg.count_all()})


@register("SELECT nullif(o_orderstatus, 'P') AS status, count(*) AS n FROM orders GROUP BY 1")
def group_by_null(t: Tables) -> DataFrame:
    return rel.aggregate(t.orders, {"status": fn.nullif(col("o_orderstatus"), F.lit("P"))}, {"n": agg.count_all()})


@register("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def having(t: Tables) -> DataFrame:
    return rel.aggregate(t.orders, {"o_custkey": "o_custkey"}, {"n": agg.count_all()}, col("n") > 15)


@register(
    """SELECT event_type, count(DISTINCT user_id) AS n_users, CAST(sum(DISTINCT user_id) AS DOUBLE) AS sum_users,
       count(DISTINCT nullif(user_id, 7)) AS n_not_7 FROM events GROUP BY event_type"""
)
def distinct_aggregates(t: Tables) -> DataFrame:
    measures = {
        "n_users": agg.count(col("user_id"), distinct=True),
        "sum_users": agg.total(col("user_id"), 0, distinct=True).cast("double"),
        "n_not_7": agg.count(fn.nullif(col("user_id"), F.lit(7)), distinct=True),
    }
    return rel.aggregate(t.events, {"event_type": "event_type"}, measures)


@register(
    """SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, string_agg(DISTINCT left(n_name, 1), ',' ORDER BY left(n_name, 1)) AS initials
       FROM nation GROUP BY n_regionkey"""
)
def group_concat(t: Tables) -> DataFrame:
    initials = fn.left(col("n_name"), F.lit(1))
    return rel.aggregate(t.nation, {"n_regionkey": "n_regionkey"}, {"names": agg.group_concat(col("n_name")), "initials": agg.group_concat(initials, distinct=True)})


@register("SELECT p_brand, min(p_name) AS first_name, max(p_type) AS last_type FROM part GROUP BY p_brand")
def min_max_text(t: Tables) -> DataFrame:
    return rel.aggregate(t.part, {"p_brand": "p_brand"}, {"first_name": agg.minimum(col("p_name")), "last_type": agg.maximum(col("p_type"))})


@register(
    """SELECT l_shipmode, CAST(round(s / n, 4) AS DOUBLE) AS mean FROM (
       SELECT l_linestatus AS l_shipmode, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS s, count(*) AS n FROM lineitem GROUP BY 1)"""
)
def average_to_four_places(t: Tables) -> DataFrame:
    return rel.aggregate(t.lineitem, {"l_shipmode": "l_linestatus"}, {"mean": agg.average(col("l_extendedprice"), 2).cast("double")})


@register(
    """SELECT event_type, CAST(sum(CAST(value AS DECIMAL(38,10))) AS DOUBLE) AS total, round(CAST(sum(CAST(value AS DECIMAL(38,10))) AS DOUBLE) / count(value), 2) AS mean,
       CAST(sum(event_id) AS DOUBLE) AS ids FROM events GROUP BY event_type"""
)
def sum_without_scale(t: Tables) -> DataFrame:
    measures = {
        "total": agg.total(col("value")).cast("double"),
        "mean": F.round(agg.average(col("value")).cast("double"), 2),
        "ids": agg.total(col("event_id")).cast("double"),
    }
    return rel.aggregate(t.events, {"event_type": "event_type"}, measures)


@register(
    """SELECT o_orderpriority, CAST(round(s / n, 4) AS DOUBLE) AS mean, n FROM (
       SELECT o_orderpriority, sum(CAST(DISTINCT_KEY AS DECIMAL(18,0))) AS s, count(*) AS n
       FROM (SELECT DISTINCT o_orderpriority, o_custkey AS DISTINCT_KEY FROM orders) GROUP BY 1)"""
)
def avg_distinct(t: Tables) -> DataFrame:
    measures = {"mean": agg.average(col("o_custkey"), distinct=True).cast("double"), "n": agg.count(col("o_custkey"), distinct=True)}
    return rel.aggregate(t.orders, {"o_orderpriority": "o_orderpriority"}, measures)


@register("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def select_distinct(t: Tables) -> DataFrame:
    return rel.distinct(t.customer.select("c_mktsegment", "c_nationkey"))


# filters


@register("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F' AND NOT o_orderpriority = '1-URGENT'")
def filter_comparison(t: Tables) -> DataFrame:
    rows = rel.select(t.orders, col("o_totalprice") > 200000, col("o_orderstatus") != "F", ~(col("o_orderpriority") == "1-URGENT"))
    return rows.select("o_orderkey", "o_totalprice")


@register("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 120000 AND o_orderkey NOT BETWEEN 100 AND 5000")
def filter_between(t: Tables) -> DataFrame:
    return rel.select(t.orders, fn.between(col("o_totalprice"), 100000, 120000), ~fn.between(col("o_orderkey"), 100, 5000)).select("o_orderkey")


@register(
    """SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 50 <> 1 THEN p_size BETWEEN p_partkey % 7 AND p_partkey % 50 END AS inside FROM part"""
)
def between_columns(t: Tables) -> DataFrame:
    key = col("p_partkey")
    inside = fn.between(col("p_size"), fn.nullif(key % 7, F.lit(0)), fn.nullif(key % 50, F.lit(1)))
    return rel.project(t.part, p_partkey="p_partkey", inside=inside)


@register("SELECT p_partkey FROM part WHERE p_size IN (1, 7, 19) AND p_brand NOT IN ('Brand#11', 'Brand#22')")
def filter_in(t: Tables) -> DataFrame:
    return rel.select(t.part, fn.in_list(col("p_size"), [1, 7, 19]), ~fn.in_list(col("p_brand"), ["Brand#11", "Brand#22"])).select("p_partkey")


@register("SELECT p_partkey, (p_size IN (1, NULL)) AS found FROM part")
def in_list_with_null(t: Tables) -> DataFrame:
    return rel.project(t.part, p_partkey="p_partkey", found=fn.in_list(col("p_size"), [1, None]))


@register("SELECT p_partkey FROM part WHERE p_type ILIKE '%_CON%' AND p_name NOT ILIKE '%7'")
def filter_like(t: Tables) -> DataFrame:
    return rel.select(t.part, fn.like(col("p_type"), "%_con%"), ~fn.like(col("p_name"), "%7")).select("p_partkey")


@register(
    """SELECT c_custkey, seg IS NULL AS missing, (seg = 'BUILDING' OR c_acctbal > 0) AS either, (seg = 'BUILDING' AND c_acctbal > 0) AS both
       FROM (SELECT c_custkey, c_acctbal, nullif(c_mktsegment, 'MACHINERY') AS seg FROM customer)"""
)
def three_valued_logic(t: Tables) -> DataFrame:
    rows = t.customer.withColumn("seg", fn.nullif(col("c_mktsegment"), F.lit("MACHINERY")))
    building, rich = col("seg") == "BUILDING", col("c_acctbal") > 0
    return rel.project(rows, c_custkey="c_custkey", missing=col("seg").isNull(), either=building | rich, both=building & rich)


# expressions


@register(
    """SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band,
       CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders"""
)
def case_expressions(t: Tables) -> DataFrame:
    price = col("o_totalprice")
    band = fn.case_when([(price > 250000, F.lit("high")), (price > 100000, F.lit("middle"))], F.lit("low"))
    code = fn.case_value(col("o_orderstatus"), [(F.lit("F"), F.lit(1)), (F.lit("O"), F.lit(2))])
    return rel.project(t.orders, o_orderkey="o_orderkey", band=band, code=code)


@register(
    """SELECT p_partkey, coalesce(TRY_CAST(p_brand AS BIGINT), 0) AS bad_int, coalesce(TRY_CAST(p_size::VARCHAR AS DOUBLE), 0) AS good_double,
       TRY_CAST(p_name AS DECIMAL(10,2))::DOUBLE AS bad_decimal, TRY_CAST(p_brand AS TIMESTAMP) IS NULL AS bad_time, p_size::VARCHAR AS as_text FROM part"""
)
def casts(t: Tables) -> DataFrame:
    return rel.project(
        t.part,
        p_partkey="p_partkey",
        bad_int=fn.cast_int(col("p_brand")),
        good_double=fn.cast_double(col("p_size").cast("string")),
        bad_decimal=fn.cast_decimal(col("p_name"), 10, 2).cast("double"),
        bad_time=fn.cast_datetime(col("p_brand")).isNull(),
        as_text=fn.cast_string(col("p_size")),
    )


@register(
    """SELECT o_orderkey, 0::BIGINT AS time_as_int, 0.0::DOUBLE AS time_as_double, TRUE AS time_as_decimal_missing,
       CAST(trunc(o_totalprice) AS BIGINT) AS price_as_int, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS time_as_text,
       o_orderkey AS text_as_int, TRUE AS blank_decimal_missing, TRUE AS day_as_time_missing, year(o_orderdate) AS text_as_time_year FROM orders"""
)
def cast_corners(t: Tables) -> DataFrame:
    key, at, price = col("o_orderkey"), col("o_orderdate"), col("o_totalprice")
    kind = t.orders.schema["o_orderdate"].dataType.simpleString()
    blank = F.concat(F.lit(" "), key.cast("string"), F.lit(" "))
    return rel.project(
        t.orders,
        o_orderkey="o_orderkey",
        time_as_int=fn.cast_int(at, kind),
        time_as_double=fn.cast_double(at, kind),
        time_as_decimal_missing=fn.cast_decimal(at, kind=kind).isNull(),
        price_as_int=fn.cast_int(price, "double"),
        time_as_text=fn.cast_string(at, kind),
        text_as_int=fn.cast_int(blank),
        blank_decimal_missing=fn.cast_decimal(blank).isNull(),
        day_as_time_missing=fn.cast_datetime(F.date_format(at, "yyyy-MM-dd")).isNull(),
        text_as_time_year=fn.year(fn.cast_datetime(F.concat(F.lit(" "), fn.text_of_time(at)))),
    )


@register(
    """SELECT p_partkey, p_size::VARCHAR < right(p_brand, 2) AS number_below_text, p_size::VARCHAR = '7' AS number_is_text,
       p_size < p_partkey AS number_below_number FROM part"""
)
def compare_mixed_types(t: Tables) -> DataFrame:
    size, end = col("p_size"), fn.right(col("p_brand"), F.lit(2))
    a, b = fn.comparable(size, "int", end, "string")
    c, d = fn.comparable(size, "int", F.lit("7"), "string")
    e, f = fn.comparable(size, "int", col("p_partkey"), "bigint")
    return rel.project(t.part, p_partkey="p_partkey", number_below_text=a < b, number_is_text=c == d, number_below_number=e < f)


@register(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') >= '1998' AS from_1998,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') = '1998-03-15 00:00:00' AS that_day FROM orders"""
)
def compare_time_with_text(t: Tables) -> DataFrame:
    kind = t.orders.schema["o_orderdate"].dataType.simpleString()
    a, b = fn.comparable(col("o_orderdate"), kind, F.lit("1998"), "string")
    c, d = fn.comparable(col("o_orderdate"), kind, F.lit("1998-03-15 00:00:00"), "string")
    return rel.project(t.orders, o_orderkey="o_orderkey", from_1998=a >= b, that_day=c == d)


@register(
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey::VARCHAR WHEN o_orderstatus = 'O' THEN o_orderpriority
       ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS mixed,
       CASE WHEN o_orderstatus = 'F' THEN o_custkey::DOUBLE ELSE o_totalprice END AS number FROM orders"""
)
def case_of_mixed_types(t: Tables) -> DataFrame:
    kind = t.orders.schema["o_orderdate"].dataType.simpleString()
    status, key = col("o_orderstatus"), col("o_custkey")
    mixed = fn.case_mixed([(status == "F", key, "bigint"), (status == "O", col("o_orderpriority"), "string")], (col("o_orderdate"), kind))
    number = fn.case_mixed([(status == "F", key, "bigint")], (col("o_totalprice"), "double"))
    return rel.project(t.orders, o_orderkey="o_orderkey", mixed=mixed, number=number)


@register(
    """SELECT n_nationkey, n_nationkey <> 0 AS number, n_name <> '' AS text, coalesce(nullif(n_regionkey, 1), nullif(n_nationkey, 2), -1) AS first_known,
       (CASE WHEN n_nationkey > 3 THEN '0' ELSE 'x' END) <> '0' AS zero FROM nation"""
)
def truth_and_coalesce(t: Tables) -> DataFrame:
    key = col("n_nationkey")
    return rel.project(
        t.nation,
        n_nationkey="n_nationkey",
        number=fn.truth(key, "int"),
        text=fn.truth(col("n_name"), "string"),
        first_known=fn.coalesce(fn.nullif(col("n_regionkey"), F.lit(1)), fn.nullif(key, F.lit(2)), F.lit(-1)),
        zero=fn.truth(fn.if_(key > 3, F.lit("0"), F.lit("x")), "string"),
    )


@register(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / (o_orderkey % 3) END AS quotient,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % (o_orderkey % 4) END AS rest,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey // (o_orderkey % 5) END AS whole,
       o_custkey * 1000000007 - o_orderkey AS product, CAST(-o_custkey AS DOUBLE) AS negative, o_totalprice * 2 + 1 AS fraction FROM orders"""
)
def arithmetic(t: Tables) -> DataFrame:
    key, customer, price = col("o_orderkey"), col("o_custkey"), col("o_totalprice")
    return rel.project(
        t.orders,
        o_orderkey="o_orderkey",
        quotient=fn.divide(price, key % 3),
        rest=fn.modulo(customer, key % 4),
        whole=fn.int_divide(customer, key % 5),
        product=fn.subtract_int(fn.multiply_int(customer, F.lit(1000000007)), key),
        negative=fn.negate(customer, "bigint").cast("double"),
        fraction=fn.add(fn.multiply(price, F.lit(2)), F.lit(1)),
    )


@register(
    """SELECT p_partkey, p_name || '-' || p_size AS joined, CAST(length(p_name) AS BIGINT) AS len, upper(p_name) AS up, lower(p_type) AS low,
       trim('  ' || p_brand || ' ') AS trimmed, replace(p_brand, 'Brand', 'B') AS replaced, left(p_type, 3) AS l3, right(p_type, 4) AS r4 FROM part"""
)
def text_functions(t: Tables) -> DataFrame:
    return rel.project(
        t.part,
        p_partkey="p_partkey",
        joined=fn.concat(col("p_name"), F.lit("-"), col("p_size")),
        len=fn.length(col("p_name")),
        up=fn.upper(col("p_name")),
        low=fn.lower(col("p_type")),
        trimmed=fn.trim(F.concat(F.lit("  "), col("p_brand"), F.lit(" "))),
        replaced=fn.replace(col("p_brand"), F.lit("Brand"), F.lit("B")),
        l3=fn.left(col("p_type"), F.lit(3)),
        r4=fn.right(col("p_type"), F.lit(4)),
    )


@register(
    """SELECT n_nationkey, substring(n_name, 2, 3) AS a, left(right(n_name, 3), 2) AS b, '' AS zero, CASE WHEN length(n_name) >= 6 THEN left(right(n_name, 6), 2) ELSE '' END AS far,
       substring(n_name, 4) AS tail, '' AS none FROM nation"""
)
def substring_edges(t: Tables) -> DataFrame:
    name = col("n_name")
    return rel.project(
        t.nation,
        n_nationkey="n_nationkey",
        a=fn.substring(name, 2, 3),
        b=fn.substring(name, -3, 2),
        zero=fn.substring(name, 0, 2),
        far=fn.substring(name, -6, 2),
        tail=fn.substring(name, 4),
        none=fn.substring(name, 1, 0),
    )


@register(
    """SELECT c_custkey, abs(c_acctbal) AS absolute, CAST(ceil(c_acctbal) AS BIGINT) AS up, CAST(floor(c_acctbal) AS BIGINT) AS down,
       CAST(round(CAST(c_acctbal AS DECIMAL(18,2)), 0) AS BIGINT) AS whole, CAST(round(CAST(c_acctbal AS DECIMAL(18,2)), 1) AS DOUBLE) AS tenth, c_custkey % 7 AS rest, CAST(power(c_custkey % 9, 2) AS DOUBLE) AS square,
       CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS root FROM customer"""
)
def number_functions(t: Tables) -> DataFrame:
    balance = col("c_acctbal")
    return rel.project(
        t.customer,
        c_custkey="c_custkey",
        absolute=fn.absolute(balance, "double"),
        up=fn.ceil(balance),
        down=fn.floor(balance),
        whole=fn.round_(balance),
        tenth=fn.round_(balance, 1),
        rest=fn.mod(col("c_custkey"), F.lit(7)),
        square=fn.power(col("c_custkey") % 9, F.lit(2)),
        root=F.round(fn.sqrt(balance), 6),
    )


@register(
    """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS shown FROM orders"""
)
def date_functions(t: Tables) -> DataFrame:
    at = col("o_orderdate")
    return rel.project(t.orders, o_orderkey="o_orderkey", y=fn.year(at), m=fn.month(at), d=fn.day(at), shown=fn.text_of_time(at))


@register(
    """SELECT c_custkey, coalesce(seg, 'none') AS filled, nullif(c_nationkey, 3) AS not_3, CASE WHEN seg IS NULL THEN -1 ELSE c_nationkey END AS chosen, seg || '!' AS shouted
       FROM (SELECT c_custkey, c_nationkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer)"""
)
def null_functions(t: Tables) -> DataFrame:
    seg = fn.nullif(col("c_mktsegment"), F.lit("BUILDING"))
    return rel.project(
        t.customer,
        c_custkey="c_custkey",
        filled=fn.ifnull(seg, F.lit("none")),
        not_3=fn.nullif(col("c_nationkey"), F.lit(3)),
        chosen=fn.if_(seg.isNull(), F.lit(-1), col("c_nationkey")),
        shouted=fn.concat(seg, F.lit("!")),
    )


# joins


@register(
    """SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000"""
)
def inner_join(t: Tables) -> DataFrame:
    rows = rel.join(t.customer, rel.select(t.orders, col("o_totalprice") > 300000), col("c_custkey") == col("o_custkey"))
    return rows.select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@register("SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND l.toxic = 0")
def left_join(t: Tables) -> DataFrame:
    d, l = t.documents.alias("d"), t.labels.alias("l")
    return rel.join(d, l, (col("d.doc_id") == col("l.doc_id")) & (col("l.toxic") == 0), "left").select("d.doc_id", "d.lang", "l.quality")


@register("SELECT l.doc_id AS label_id, l.quality, d.n_chars FROM documents d RIGHT JOIN labels l ON d.doc_id = l.doc_id AND d.n_chars > 1000")
def right_join(t: Tables) -> DataFrame:
    d, l = t.documents.alias("d"), t.labels.alias("l")
    rows = rel.join(d, l, (col("d.doc_id") == col("l.doc_id")) & (col("d.n_chars") > 1000), "right")
    return rows.select(col("l.doc_id").alias("label_id"), "l.quality", "d.n_chars")


@register("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join(t: Tables) -> DataFrame:
    return rel.join(t.region, t.nation, kind="cross").select("r_name", "n_name")


@register("SELECT c_custkey, n_name, r_name FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'")
def comma_join(t: Tables) -> DataFrame:
    rows = rel.join(rel.join(t.customer, t.nation, kind="cross"), t.region, kind="cross")
    rows = rel.select(rows, col("c_nationkey") == col("n_nationkey"), col("n_regionkey") == col("r_regionkey"), col("r_name") == "ASIA")
    return rows.select("c_custkey", "n_name", "r_name")


@register("SELECT a.n_name AS left_name, b.n_name AS right_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def self_join(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    on = (col("a.n_regionkey") == col("b.n_regionkey")) & (col("a.n_nationkey") < col("b.n_nationkey"))
    return rel.join(a, b, on).select(col("a.n_name").alias("left_name"), col("b.n_name").alias("right_name"))


@register("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey > n_nationkey + 20")
def theta_join(t: Tables) -> DataFrame:
    return rel.join(t.supplier, t.nation, col("s_nationkey") > col("n_nationkey") + 20).select("s_suppkey", "n_nationkey")


@register(
    """SELECT c.c_custkey, o.n, o.best FROM customer c JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS best FROM orders GROUP BY o_custkey) o
       ON c.c_custkey = o.o_custkey WHERE o.n >= 12"""
)
def derived_table_join(t: Tables) -> DataFrame:
    o = rel.aggregate(t.orders, {"o_custkey": "o_custkey"}, {"n": agg.count_all(), "best": agg.maximum(col("o_totalprice"))}, col("n") >= 12)
    return rel.join(t.customer, o, col("c_custkey") == col("o_custkey")).select("c_custkey", "n", "best")


@register("SELECT n.*, r_name FROM nation n JOIN region r ON n_regionkey = r_regionkey")
def qualified_star(t: Tables) -> DataFrame:
    return rel.join(t.nation.alias("n"), t.region.alias("r"), col("n.n_regionkey") == col("r.r_regionkey")).select("n.*", "r_name")


@register(
    """SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) c
       LEFT JOIN (SELECT s_suppkey, nullif(s_nationkey, 3) AS k FROM supplier) s ON c.k = s.k"""
)
def join_on_null_keys(t: Tables) -> DataFrame:
    c = rel.project(t.customer, c_custkey="c_custkey", k=fn.nullif(col("c_nationkey"), F.lit(3)))
    s = rel.project(t.supplier, s_suppkey="s_suppkey", j=fn.nullif(col("s_nationkey"), F.lit(3)))
    return rel.join_lists(c, s, "k", "j", "left")


@register("SELECT o_orderkey, points FROM orders JOIN (VALUES ('1-URGENT', 5), ('2-HIGH', 3), (NULL, 1)) p(priority, points) ON o_orderpriority = priority")
def join_with_values(t: Tables) -> DataFrame:
    p = rel.values(t.spark, [("1-URGENT", 5), ("2-HIGH", 3), (None, 1)], "priority string, points int")
    return rel.join(t.orders, p, col("o_orderpriority") == col("priority")).select("o_orderkey", "points")


# subqueries


@register("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def scalar_subquery(t: Tables) -> DataFrame:
    rows = rel.with_scalar(t.part, "mean", t.part.agg(F.avg("p_retailprice")))
    return rel.select(rows, col("p_retailprice") > col("mean")).select("p_partkey", "p_retailprice")


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def in_subquery(t: Tables) -> DataFrame:
    return rel.where_in(t.customer, "c_custkey", rel.select(t.orders, col("o_orderstatus") == "P").select("o_custkey")).select("c_custkey")


@register("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def not_in_subquery(t: Tables) -> DataFrame:
    return rel.where_not_in(t.customer, "c_custkey", rel.select(t.orders, col("o_totalprice") > 100000).select("o_custkey")).select("c_custkey")


@register("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 1) FROM orders WHERE o_totalprice > 100000 OR o_custkey = 1)")
def not_in_subquery_with_null(t: Tables) -> DataFrame:
    rows = rel.select(t.orders, (col("o_totalprice") > 100000) | (col("o_custkey") == 1))
    return rel.where_not_in(t.customer, "c_custkey", rows.select(fn.nullif(col("o_custkey"), F.lit(1)))).select("c_custkey")


@register("SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1)")
def exists_subquery(t: Tables) -> DataFrame:
    return rel.where_exists(t.supplier, rel.select(t.orders, col("o_totalprice") > 1)).select("s_suppkey")


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)")
def not_exists_correlated(t: Tables) -> DataFrame:
    rows = rel.select(t.orders, col("o_orderstatus") == "P", col("o_totalprice") > 200000)
    return rel.where_exists(t.customer, rows, col("o_custkey") == col("c_custkey"), negate=True).select("c_custkey")


# order, limit, unions


@register("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(t: Tables) -> DataFrame:
    return rel.top_k(t.orders, 25, col("o_totalprice").desc(), col("o_orderkey")).select("o_orderkey", "o_totalprice")


@register("SELECT o_orderkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10 OFFSET 40")
def limit_offset(t: Tables) -> DataFrame:
    return rel.top_k(t.orders, 10, "o_orderdate", "o_orderkey", offset=40).select("o_orderkey")


@register("SELECT c_custkey, seg FROM (SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg FROM customer) ORDER BY seg NULLS FIRST, c_custkey LIMIT 30")
def sort_with_nulls(t: Tables) -> DataFrame:
    rows = rel.project(t.customer, c_custkey="c_custkey", seg=fn.nullif(col("c_mktsegment"), F.lit("BUILDING")))
    return rel.top_k(rows, 30, "seg", "c_custkey")


@register("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey")
def full_sort(t: Tables) -> DataFrame:
    return rel.sort(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), col("o_orderstatus").desc(), "o_totalprice", "o_orderkey")


@register("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return rel.union(t.customer.select(col("c_nationkey").alias("k")), t.supplier.select("s_nationkey"), all_=True)


@register("SELECT c_nationkey AS k, c_mktsegment AS s FROM customer UNION SELECT s_nationkey, NULL FROM supplier UNION SELECT n_nationkey, NULL FROM nation")
def union_distinct(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    return rel.union(
        rel.project(t.customer, k="c_nationkey", s="c_mktsegment"), rel.project(t.supplier, k="s_nationkey", s=none), rel.project(t.nation, k="n_nationkey", s=none)
    )


@register("SELECT 1 + 1 AS two, 'a' || 'b' AS ab, NULL IS NULL AS yes, count(*) AS n FROM region GROUP BY ALL")
def dual_expression(t: Tables) -> DataFrame:
    rows = rel.dual(t.spark, two=fn.add_int(F.lit(1), F.lit(1)), ab=fn.concat(F.lit("a"), F.lit("b")), yes=F.lit(None).isNull())
    return rel.with_scalar(rows, "n", t.region.agg(agg.count_all()))


# statistics and changes


@register(
    """SELECT 'o_custkey' AS "column", count(*) AS n_rows, count(*) - count(o_custkey) AS n_nulls, count(DISTINCT o_custkey) AS n_distinct,
       min(o_custkey)::VARCHAR AS low, max(o_custkey)::VARCHAR AS high FROM orders
       UNION ALL SELECT 'o_orderstatus', count(*), count(*) - count(o_orderstatus), count(DISTINCT o_orderstatus), min(o_orderstatus), max(o_orderstatus) FROM orders"""
)
def analyze_columns(t: Tables) -> DataFrame:
    return statistics.column_statistics(t.orders, ["o_custkey", "o_orderstatus"])


@register(
    """WITH v AS (SELECT o_custkey AS v, count(*) AS n FROM orders GROUP BY 1),
       r AS (SELECT v, n, CAST((sum(n) OVER (ORDER BY v) - 1) * 256 // (SELECT count(o_custkey) FROM orders) AS INTEGER) AS bucket FROM v)
       SELECT bucket, min(v) AS low, max(v) AS high, CAST(sum(n) AS BIGINT) AS n, CAST(max_by(n, v) AS BIGINT) AS repeats, count(*) AS n_distinct FROM r GROUP BY bucket"""
)
def histogram_totals(t: Tables) -> DataFrame:
    """Every bucket of the 256 of a column."""
    return statistics.histogram(t.orders, "o_custkey", 256)


@register("SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS n_distinct, min(p_size) AS low, max(p_size) AS high FROM (SELECT p_size, count(*) AS n FROM part GROUP BY p_size)")
def histogram_of_few_values(t: Tables) -> DataFrame:
    """More buckets than values: one value a bucket at most."""
    h = statistics.histogram(t.part, "p_size", 256)
    return h.agg(F.sum("n").alias("n"), F.sum("n_distinct").alias("n_distinct"), F.min("low").alias("low"), F.max("high").alias("high"))


@register(
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM orders"""
)
def update_rows(t: Tables) -> DataFrame:
    rows = t.orders.drop("o_orderdate")
    return change.update(rows, {"o_orderstatus": F.lit("F"), "o_totalprice": col("o_totalprice") * 2}, col("o_orderstatus") == "P")


@register(
    """SELECT c.c_custkey, c.c_name, CASE WHEN o.o_custkey IS NULL THEN c.c_acctbal ELSE 0 END AS c_acctbal
       FROM customer c LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 300000) o ON c.c_custkey = o.o_custkey"""
)
def update_from_join(t: Tables) -> DataFrame:
    heavy = rel.select(t.orders, col("o_totalprice") > 300000).select(col("o_custkey").alias("c_custkey"))
    return change.update_join(t.customer.select("c_custkey", "c_name", "c_acctbal"), heavy, ["c_custkey"], {"c_acctbal": F.lit(0.0)})


@register("SELECT p_partkey, p_name FROM part WHERE NOT coalesce(nullif(p_size, 5) > 10, FALSE)")
def delete_rows(t: Tables) -> DataFrame:
    return change.delete(t.part, fn.nullif(col("p_size"), F.lit(5)) > 10).select("p_partkey", "p_name")


@register("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def delete_from_join(t: Tables) -> DataFrame:
    gone = rel.select(t.nation, col("n_regionkey") == 2).select(col("n_nationkey").alias("s_nationkey"))
    return change.delete_join(t.supplier, gone, ["s_nationkey"]).select("s_suppkey", "s_name")


@register(
    """SELECT s_suppkey, s_name FROM supplier UNION ALL
       SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY n_name), n_name FROM (SELECT DISTINCT n_name FROM nation WHERE n_nationkey = 3)"""
)
def insert_rows(t: Tables) -> DataFrame:
    new = rel.select(t.nation, col("n_nationkey") == 3).select(col("n_name").alias("s_name"))
    return change.insert(t.supplier.select("s_suppkey", "s_name"), new, [["s_suppkey"]], auto="s_suppkey")


@register(
    """SELECT c_custkey, c_name, CASE WHEN o.best IS NULL THEN c_acctbal ELSE o.best END AS c_acctbal FROM customer
       LEFT JOIN (SELECT o_custkey, min(o_totalprice) AS best FROM orders GROUP BY o_custkey) o ON c_custkey = o_custkey"""
)
def update_by_one_of_several(t: Tables) -> DataFrame:
    """A row with several partners takes the smallest one."""
    o = rel.project(t.orders, c_custkey="o_custkey", price="o_totalprice")
    return change.update_join(t.customer.select("c_custkey", "c_name", "c_acctbal"), o, ["c_custkey"], {"c_acctbal": col("o_price")})


@register(
    """SELECT s_suppkey, s_name, s_nationkey FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + n_nationkey + 1, n_name, n_nationkey FROM nation"""
)
def insert_numbered_rows(t: Tables) -> DataFrame:
    """The nations take the numbers after the largest one, in any order; each number once."""
    new = rel.project(t.nation, s_name="n_name", s_nationkey="n_nationkey")
    out = change.insert(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), new.orderBy("s_nationkey"), [["s_suppkey"]], auto="s_suppkey")
    return out


@register("SELECT s_suppkey, NULL::INTEGER AS rating, s_name, s_nationkey FROM supplier")
def add_and_drop_column(t: Tables) -> DataFrame:
    return change.drop_column(change.add_column(t.supplier, "rating", "int", after="s_suppkey"), "s_acctbal")


@register("SELECT s_suppkey, s_name FROM supplier WHERE FALSE UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey = 1")
def truncate_and_insert(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    return change.insert(change.truncate(rows), rel.select(rows, col("s_nationkey") == 1)).select("s_suppkey", "s_name")


# star-schema queries over several operators


@register(
    """SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority
       FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
       WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15'
       GROUP BY l_orderkey, o_orderdate, o_orderpriority"""
)
def shipping_priority(t: Tables) -> DataFrame:
    o = rel.select(t.orders, col("o_orderdate") < ts("1998-03-15"))
    c = rel.select(t.customer, col("c_mktsegment") == "BUILDING")
    li = rel.select(t.lineitem, col("l_shipdate") > ts("1998-03-15"))
    rows = rel.join(rel.join(c, o, col("c_custkey") == col("o_custkey")), li, col("l_orderkey") == col("o_orderkey"))
    keys = {"l_orderkey": "l_orderkey", "day": F.date_format("o_orderdate", "yyyy-MM-dd"), "o_orderpriority": "o_orderpriority"}
    return rel.aggregate(rows, keys, {"revenue": agg.total(col("l_extendedprice"), 2).cast("double")})


@register(
    """SELECT n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
       JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name"""
)
def local_supplier_volume(t: Tables) -> DataFrame:
    n = rel.join(t.nation, rel.select(t.region, col("r_name") == "ASIA"), col("n_regionkey") == col("r_regionkey"))
    s = rel.join(t.supplier, n, col("s_nationkey") == col("n_nationkey"))
    co = rel.join(t.customer, t.orders, col("c_custkey") == col("o_custkey"))
    rows = rel.join(rel.join(t.lineitem, co, col("l_orderkey") == col("o_orderkey")), s, (col("l_suppkey") == col("s_suppkey")) & (col("c_nationkey") == col("s_nationkey")))
    return rel.aggregate(rows, {"n_name": "n_name"}, {"revenue": agg.total(col("l_extendedprice"), 2).cast("double")})


@register(
    """SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem
       WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_discount BETWEEN 0.03 AND 0.07 AND l_quantity < 24"""
)
def revenue_forecast(t: Tables) -> DataFrame:
    rows = rel.select(
        t.lineitem, col("l_shipdate") >= ts("1997-01-01"), col("l_shipdate") < ts("1998-01-01"), fn.between(col("l_discount"), 0.03, 0.07), col("l_quantity") < 24
    )
    return rel.aggregate(rows, {}, {"revenue": agg.total(fn.multiply(col("l_extendedprice"), col("l_discount")), 4).cast("double")})


@register(
    """SELECT c_custkey, c_name, n_name, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
       JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name
       ORDER BY revenue DESC, c_custkey LIMIT 20"""
)
def returned_items(t: Tables) -> DataFrame:
    li = rel.select(t.lineitem, col("l_returnflag") == "R")
    rows = rel.join(rel.join(li, t.orders, col("l_orderkey") == col("o_orderkey")), t.customer, col("c_custkey") == col("o_custkey"))
    rows = rel.join(rows, t.nation, col("c_nationkey") == col("n_nationkey"))
    out = rel.aggregate(rows, {c: c for c in ("c_custkey", "c_name", "n_name")}, {"revenue": agg.total(col("l_extendedprice"), 2).cast("double")})
    return rel.top_k(out, 20, col("revenue").desc(), "c_custkey")
