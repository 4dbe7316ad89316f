import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.functions import aggregate as agg
from millrace.functions import scalar as fn
from millrace.operators import relational as rel


def value(spark, column):
    return rel.dual(spark, v=column).first()["v"]


def cases():
    L = F.lit
    NULL = L(None).cast("string")
    return [
        (fn.divide(L(1), L(0)), None),
        (fn.divide(L(7), L(2)), 3.5),
        (fn.modulo(L(7), L(0)), None),
        (fn.modulo(L(-7), L(3)), -1),
        (fn.int_divide(L(-7), L(2)), -3),
        (fn.int_divide(L(9007199254740993), L(1)), 9007199254740993),
        (fn.int_divide(L(7), L(0)), None),
        (fn.int_divide(L(7.9), L(2.9)), 3),
        (fn.add_int(L(2147483647), L(1)), 2147483648),
        (fn.mod(L(7.9), L(3)), 1),
        (fn.mod(L(7), L(0)), None),
        (fn.sqrt(L(-1)), None),
        (fn.sqrt(L(16)), 4.0),
        (fn.power(L(2), L(10)), 1024.0),
        (fn.round_(L(2.5)), 3),
        (fn.round_(L(-2.5)), -3),
        (fn.round_(L(2.345), 2), 2.35),
        (fn.ceil(L(1.2)), 2),
        (fn.floor(L(-1.2)), -2),
        (fn.absolute(L(-5), "int"), 5),
        (fn.absolute(L(-(1 << 63)), "bigint"), Decimal(1 << 63)),
        (fn.absolute(L(Decimal("-1.5")), "decimal(2,1)"), 1.5),
        (fn.negate(L(5), "int"), -5),
        (fn.negate(L(-(1 << 63)), "bigint"), Decimal(1 << 63)),
        (fn.negate(L(" 2.5 "), "string"), -2.5),
        (fn.negate(L("x"), "string"), 0.0),
        (fn.substring(L("hello"), 2, 3), "ell"),
        (fn.substring(L("hello"), 0, 3), ""),
        (fn.substring(L("hello"), -3), "llo"),
        (fn.substring(L("hello"), -6, 3), ""),
        (fn.substring(L("hello"), 9), ""),
        (fn.substring(L("hello"), 2, 0), ""),
        (fn.substring(NULL, 1, 2), None),
        (fn.left(L("hello"), L(2)), "he"),
        (fn.right(L("hello"), L(2)), "lo"),
        (fn.trim(L(" \t a b \n")), "a b"),
        (fn.length(L("héé")), 3),
        (fn.concat(L("a"), L(1), L("b")), "a1b"),
        (fn.concat(L("a"), NULL), None),
        (fn.replace(L("aXbX"), L("X"), L("-")), "a-b-"),
        (fn.upper(L("ab")), "AB"),
        (fn.lower(L("AB")), "ab"),
        (fn.like(L("Hello"), "h_LL%"), True),
        (fn.like(L("a%b"), r"a\%B"), True),
        (fn.like(L("axb"), r"a\%b"), False),
        (fn.between(L(2), L(1), L(3)), True),
        (fn.between(L(2), L(None).cast("int"), L(1)), None),
        (fn.in_list(L(1), [1, None]), True),
        (fn.in_list(L(2), [1, None]), None),
        (fn.if_(L(True), L("y"), L("n")), "y"),
        (fn.ifnull(NULL, L("x")), "x"),
        (fn.nullif(L(1), L(1)), None),
        (fn.coalesce(NULL, L("b")), "b"),
        (fn.case_value(L(None).cast("int"), [(L(None).cast("int"), L("null"))], L("else")), "else"),
        (fn.cast_int(L("12")), 12),
        (fn.cast_int(L("abc")), 0),
        (fn.cast_int(NULL), None),
        (fn.cast_int(L(" 5 ")), 5),
        (fn.cast_int(L("5.5")), 0),
        (fn.cast_int(L(-7.9), "double"), -7),
        (fn.cast_int(L(1e300), "double"), (1 << 63) - 1),
        (fn.cast_int(L(-1e300), "double"), -(1 << 63)),
        (fn.cast_int(L(float("nan")), "double"), 0),
        (fn.cast_int(L("2024-05-06").cast("timestamp_ntz"), "timestamp_ntz"), 0),
        (fn.cast_int(L(None).cast("timestamp_ntz"), "timestamp_ntz"), None),
        (fn.cast_double(L("2024-05-06").cast("date"), "date"), 0.0),
        (fn.cast_decimal(L(" 5 ")), None),
        (fn.cast_decimal(L("5")), Decimal(5)),
        (fn.cast_decimal(L("2024-05-06").cast("date"), kind="date"), None),
        (fn.cast_datetime(L("2024-01-02")), None),
        (fn.cast_datetime(L(" 2024-01-02 03:04:05\n")), datetime.datetime(2024, 1, 2, 3, 4, 5)),
        (fn.cast_datetime(L("2024-13-02 03:04:05")), None),
        (fn.cast_string(L("2024-05-06").cast("timestamp_ntz"), "timestamp_ntz"), "2024-05-06 00:00:00"),
        (fn.cast_string(L(True), "boolean"), "1"),
        (fn.cast_string(L(b"\x0a").cast("binary"), "binary"), "0x0A"),
        (fn.cast_double(L("x")), 0.0),
        (fn.between(L(2), 1, 3), True),
        (fn.between(L(None).cast("int"), 1, 3), None),
        (fn.case_mixed([(L(False), L(1), "int")], (L("b"), "string")), "b"),
        (fn.case_mixed([(L(True), L(1), "int")], (L("b"), "string")), "1"),
        (fn.case_mixed([(L(True), L(1), "int")], (L(2.5), "double")), 1.0),
        (fn.case_mixed([(L(True), L(1), "int")], (L(Decimal("2.5")), "decimal(2,1)")), Decimal(1)),
        (fn.case_mixed([(L(False), L(1), "int")], (NULL, "void")), None),
        (fn.cast_decimal(L("1.26"), 10, 1), Decimal("1.3")),
        (fn.cast_decimal(L("x")), None),
        (fn.cast_datetime(L("nope")), None),
        (fn.cast_datetime(L("2024-01-02 03:04:05")), datetime.datetime(2024, 1, 2, 3, 4, 5)),
        (fn.truth(L("0"), "string"), False),
        (fn.truth(L("a"), "string"), True),
        (fn.truth(L(0), "int"), False),
        (fn.year(L("2024-05-06").cast("timestamp_ntz")), 2024),
        (fn.day(L("2024-05-06").cast("timestamp_ntz")), 6),
        (fn.lit(5), 5),
        (fn.lit(1.5), 1.5),
    ]


def test_scalars(spark):
    wrong = []
    for k, (column, expected) in enumerate(cases()):
        got = value(spark, column)
        if got != expected or type(got) is not type(expected):
            wrong.append((k, got, expected))
    assert not wrong


def test_numbers_against_text_compare_as_text(spark):
    a, b = fn.comparable(F.lit(10), "int", F.lit("9"), "string")
    assert value(spark, a < b) is True
    a, b = fn.comparable(F.lit(10), "int", F.lit(9.5), "double")
    assert value(spark, a > b) is True
    a, b = fn.comparable(F.lit("2024-05-06").cast("timestamp_ntz"), "timestamp_ntz", F.lit("2024-05-06"), "string")
    assert value(spark, a > b) is True


def test_int_overflow_is_an_error(spark):
    with pytest.raises(Exception, match="overflow|OVERFLOW"):
        value(spark, fn.add_int(F.lit(9223372036854775807), F.lit(1)))


def test_clock(spark):
    row = rel.dual(spark, a=fn.now(), b=fn.curdate(), r=fn.rand()).first()
    assert row.b <= row.a and row.b.hour == 0 and 0 <= row.r < 1


def test_aggregates(spark):
    df = rel.values(spark, [("a", 1), ("a", 1), ("a", None), ("b", None)], "k string, v int")
    out = rel.aggregate(
        df,
        {"k": "k"},
        {
            "n": agg.count_all(),
            "c": agg.count(F.col("v")),
            "d": agg.count(F.col("v"), distinct=True),
            "s": agg.total(F.col("v")),
            "sd": agg.total(F.col("v"), distinct=True),
            "a": agg.average(F.col("v")),
            "g": agg.group_concat(F.col("v")),
            "gd": agg.group_concat(F.col("v"), distinct=True),
        },
    )
    got = {r.k: r.asDict() for r in out.collect()}
    assert got["a"] == {"k": "a", "n": 3, "c": 2, "d": 1, "s": Decimal(2), "sd": Decimal(1), "a": Decimal(1), "g": "1,1", "gd": "1"}
    assert got["b"] == {"k": "b", "n": 1, "c": 0, "d": 0, "s": None, "sd": None, "a": None, "g": None, "gd": None}


def test_average_rounds_half_up_to_four_places(spark):
    df = rel.values(spark, [(1,), (1,), (0,)], "v int")
    assert df.agg(agg.average(F.col("v")).alias("v")).first().v == Decimal("0.6667")


def test_sums_are_exact_without_a_scale(spark):
    df = rel.values(spark, [(0.4, 5 * 10**18), (0.4, 5 * 10**18), (1.5, 9223372036854775807)], "d double, n bigint")
    row = df.agg(*[a(F.col(c), distinct=x).alias(f"{k}{c}{x}") for k, a in (("s", agg.total), ("a", agg.average)) for c in "dn" for x in (False, True)]).first()
    assert row.sdFalse == Decimal("2.3") and row.sdTrue == Decimal("1.9") and row.adFalse == Decimal("0.7667") and row.adTrue == Decimal("0.95")
    assert row.snFalse == 10**19 + 9223372036854775807 and row.snTrue == 5 * 10**18 + 9223372036854775807
    assert row.anTrue == Decimal("7111686018427387903.5") and row.anFalse == Decimal("6407790678951591935.6667")
