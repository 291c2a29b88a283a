import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar

NAN, INF = float("nan"), float("inf")


def values(spark, ddl, rows, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i INT, {ddl}")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_log_return_is_null_where_the_logarithm_is_undefined(spark):
    rows = [(-100.0,), (-150.0,), (None,), (0.0,), (10.0,)]
    got = values(spark, "x DOUBLE", rows, scalar.log_return("x"))
    assert got[:4] == [None, None, None, 0.0]
    assert got[4] == pytest.approx(math.log(1.1))


def test_ratio_is_null_for_a_zero_or_missing_denominator(spark):
    rows = [(1.0, 0.0), (0.0, 0.0), (-1.0, 0.0), (1.0, None), (3.0, 2.0)]
    got = values(spark, "a DOUBLE, b DOUBLE", rows, scalar.ratio("a", "b"))
    assert got == [None, None, None, None, 1.5]


def test_membership_is_exact_and_a_null_is_no_member(spark):
    rows = [("USDT",), (None,), ("usdt",), (" USDT",)]
    got = values(spark, "s STRING", rows, scalar.member_flag("s", {"USDT", "DAI"}))
    assert got == [True, False, False, False]


def test_checks_reject_null_and_nan(spark):
    rows = [(1.0,), (0.0,), (-1.0,), (None,), (NAN,), (INF,)]
    assert values(spark, "x DOUBLE", rows, scalar.positive("x")) == [
        True, False, False, False, False, True,
    ]
    assert values(spark, "x DOUBLE", rows, scalar.non_negative("x")) == [
        True, True, False, False, False, True,
    ]


def test_range_is_inclusive(spark):
    rows = [(1.0,), (10.0,), (0.0,), (11.0,), (None,), (1.5,)]
    assert values(spark, "x DOUBLE", rows, scalar.in_range("x", 1, 10)) == [
        True, True, False, False, False, True,
    ]


def test_mixed_time_formats_in_one_column(spark):
    rows = [
        ("2026-05-22T14:17:13+00:00",), ("2026-05-22T14:17:13.123456+00:00",),
        ("2013-04-28T00:00:00.000Z",), ("2026-05-22T16:17:13+02:00",), ("junk",), (None,),
    ]
    got = values(spark, "t STRING", rows, scalar.parse_time("t").cast("timestamp_ntz"))
    assert got == [
        datetime(2026, 5, 22, 14, 17, 13), datetime(2026, 5, 22, 14, 17, 13, 123456),
        datetime(2013, 4, 28), datetime(2026, 5, 22, 14, 17, 13), None, None,
    ]


def test_strict_time_raises_on_junk(spark):
    with pytest.raises(Exception, match="junk"):
        values(spark, "t STRING", [("junk",)], scalar.parse_time("t", strict=True))


def test_nan_becomes_null(spark):
    got = values(spark, "x DOUBLE", [(NAN,), (None,), (2.0,)], scalar.nan_to_null("x"))
    assert got == [None, None, 2.0]
    flags = values(spark, "x DOUBLE", [(None,), (2.0,)], scalar.present_flag(F.col("x")))
    assert flags == [False, True]
