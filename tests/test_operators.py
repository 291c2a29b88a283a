from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import dedup, nested, quality, reports
from tidemark.operators.quality import Check, QualityError

T1, T2 = datetime(2024, 1, 1), datetime(2024, 1, 3, 0, 5)
KEYED = "s STRING, t TIMESTAMP, n INT"


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- nested


def test_flatten_names_columns_by_path_and_keeps_arrays(spark):
    df = spark.createDataFrame(
        [(1, ((2.5, "x"),), ["a"]), (2, None, None)],
        "id INT, quote STRUCT<USD: STRUCT<price: DOUBLE, at: STRING>>, tags ARRAY<STRING>",
    )
    flat = nested.flatten_structs(df)
    assert flat.columns == ["id", "quote_USD_price", "quote_USD_at", "tags"]
    assert rows(flat, "id") == [(1, 2.5, "x", ["a"]), (2, None, None, None)]


def test_flatten_refuses_two_columns_of_one_name(spark):
    df = spark.createDataFrame([(1, (2,))], "a_b INT, a STRUCT<b: INT>")
    with pytest.raises(ValueError, match="a_b"):
        nested.flatten_structs(df)


def test_explode_keeps_place_and_text(spark):
    df = spark.createDataFrame(
        [(1, ['{"a": 1, "z": 9}', '{"a": 2}']), (2, []), (3, None)], "id INT, data ARRAY<STRING>"
    )
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    got = nested.explode_records(df, "data", "place", schema, "raw")
    assert got.columns == ["id", "place", "raw", "a"]
    assert rows(got, "place") == [(1, 0, '{"a": 1, "z": 9}', 1), (1, 1, '{"a": 2}', 2)]
    counts = df.select("id", nested.array_length("data"))
    assert rows(counts, "id") == [(1, 2), (2, 0), (3, 0)]


# --- duplicates


def test_keep_first_treats_null_keys_as_equal(spark):
    df = spark.createDataFrame(
        [("a", None, 1), ("a", None, 2), ("a", T1, 3), (None, T1, 4), (None, T1, 5)], KEYED
    )
    first = dedup.keep_first(df, ["s", "t"], ["n"])
    assert sorted(r["n"] for r in first.collect()) == [1, 3, 4]
    again = dedup.keep_first(first, ["s", "t"], ["n"])
    assert again.count() == 3
    assert rows(dedup.dedup_counts(df, ["s", "t"])) == [(5, 3, 2)]
    assert sorted(r["copies"] for r in dedup.duplicate_keys(df, ["s", "t"]).collect()) == [2, 2]


def test_many_copies_of_a_key_are_cut_down_before_the_shuffle(spark):
    copy_of = (F.col("id") % 2).cast("string")
    df = spark.range(10).select(copy_of.alias("s"), copy_of.alias("t"), F.col("id").alias("n"))
    plan = plan_of(dedup.keep_first(df, ["s", "t"], ["n"]))
    below = plan.split("Exchange")[1]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_keep_first_new_leaves_out_stored_keys(spark):
    df = spark.createDataFrame([("a", T1, 1), ("a", T2, 2), ("a", T2, 3), (None, T1, 4)], KEYED)
    stored = spark.createDataFrame([("a", T1, 9), (None, T1, 9), ("b", T1, 9)], KEYED)
    assert rows(dedup.keep_first_new(df, stored, ["s", "t"], ["n"])) == [("a", T2, 2)]
    assert dedup.keep_first_new(df, stored.limit(0), ["s", "t"], ["n"]).count() == 3


# --- quality



@pytest.fixture
def checks(spark):
    return [Check("big", F.col("n") > 1), Check("named", F.col("s").isNotNull())]


def test_report_counts_failing_rows_and_copies(spark, checks):
    df = spark.createDataFrame(
        [("a", T1, 1), ("a", T1, 2), ("a", T1, 3), (None, T1, None)], KEYED
    )
    got = rows(quality.check_report(df, checks, unique=["s", "t"]))
    assert got == [("big", False, 2), ("named", False, 1), ("unique_s_t", False, 2)]
    assert rows(quality.check_report(df, checks)) == got[:2]
    with pytest.raises(QualityError, match="big: 2 rows, named: 1 rows"):
        quality.gate(quality.check_report(df, checks))


def test_no_rows_pass_every_check(spark, checks):
    df = spark.createDataFrame([], KEYED)
    report = quality.check_report(df, checks, unique=["s", "t"])
    assert [r["passed"] for r in report.collect()] == [True] * 3
    quality.gate(report)
    assert quality.null_profile(df).count() == 0


def test_split_loses_no_row_and_names_the_checks(spark, checks):
    df = spark.createDataFrame([("a", T1, 1), ("a", T1, 2), (None, T1, None)], KEYED)
    good, failing = quality.split_rows(df, checks)
    assert [r["n"] for r in good.collect()] == [2]
    assert sorted(r["failed_checks"] for r in failing.collect()) == [["big"], ["big", "named"]]


def test_enforce_stops_the_job_that_uses_the_rows(spark, checks):
    df = spark.createDataFrame([("a", T1, 2), ("a", T1, 3)], KEYED)
    assert quality.enforce(df, checks).count() == 2
    bad = df.unionByName(spark.createDataFrame([("a", T1, 0)], KEYED))
    with pytest.raises(Exception, match="check failed: big"):
        quality.enforce(bad, checks).collect()
    assert quality.enforce(df, []).count() == 2


def test_null_profile_lists_only_columns_with_nulls(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1), (None, float("nan"), 2), ("b", None, 3), ("c", 1.0, 4)],
        "s STRING, x DOUBLE, n INT",
    )
    assert rows(quality.null_profile(df)) == [("x", 2, 50.0), ("s", 1, 25.0)]


# --- reports


def test_latest_snapshot_is_the_global_last_time(spark):
    df = spark.createDataFrame([("a", T1, 1), ("a", T2, 2), ("b", T2, 3), ("c", None, 4)], KEYED)
    assert sorted(r["n"] for r in reports.latest_snapshot(df, "t").collect()) == [2, 3]
    timed = reports.latest_snapshot(df, "t", times=spark.createDataFrame([(T1,)], "t TIMESTAMP"))
    assert [r["n"] for r in timed.collect()] == [1]
    dated = df.withColumn("d", F.to_date("t"))
    known = reports.latest_snapshot(dated, "t", "d", on=T2.date())
    assert sorted(r["n"] for r in known.collect()) == [2, 3]
    assert sorted(r["n"] for r in reports.latest_snapshot(dated, "t", "d").collect()) == [2, 3]


def test_rankings_put_nulls_last(spark):
    df = spark.createDataFrame([("a", T1, 1), ("b", T1, None), ("c", T1, 3)], KEYED)
    assert [r["n"] for r in reports.ranked_report(df, ["n"], "n").collect()] == [3, 1, None]


def test_overview_spans_whole_days(spark):
    df = spark.createDataFrame([("a", T1, 1), ("b", T2, 2), (None, T2, 3)], KEYED)
    got = reports.data_overview(df, "s", "t").first()
    assert (got["keys"], got["snapshots"], got["span_minutes"]) == (2, 2, 2885)
    assert reports.data_overview(df, "s", "t", approximate=True).first() == got
    assert [r[0] for r in reports.snapshot_times(df, "t").collect()] == [T1, T2]


@pytest.mark.parametrize(("start", "limit"), [(1, 3), (3, 4), (1001, 50)])
def test_top_slice_is_exact(spark, start, limit):
    df = spark.range(4000).select(
        (F.col("id") % 3).alias("snap"), F.col("id").alias("v"), (F.col("id") % 7).alias("g")
    )
    got = reports.top_per_snapshot(df, "snap", [F.col("v").desc()], start, limit)
    for snap in range(3):
        ordered = sorted((i for i in range(4000) if i % 3 == snap), reverse=True)
        mine = sorted((r["rank"], r["v"]) for r in got.filter(f"snap = {snap}").collect())
        assert mine == list(enumerate(ordered, 1))[start - 1: start + limit - 1]


def test_profiles_and_new_columns(spark):
    before = spark.createDataFrame([(1, "a")], "x INT, y STRING")
    after = before.withColumns({"b": F.lit(1), "a": F.lit(None).cast("int")})
    assert rows(reports.new_columns(after, before)) == [("a", 4), ("b", 4)]
    assert "Aggregate" not in plan_of(reports.new_columns(after, before))
    assert rows(reports.new_columns(after, before, counts=True)) == [("a", 0, 1, 4), ("b", 1, 1, 4)]
    for counts in (False, True):
        assert reports.new_columns(before, after, counts).count() == 0
    assert [tuple(r) for r in reports.table_profile(before).orderBy("position").collect()] == [
        (0, "x", "int", 1, 2), (1, "y", "string", 1, 2),
    ]


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("poor", [False, True])
def test_deep_slices_equal_plain_ranks(spark, monkeypatch, descending, poor):
    """Also where the sketch puts the threshold too high, with ties, nulls, NaN and small groups."""
    if poor:
        monkeypatch.setattr(reports, "_KLL_ERROR", 1e-6)
        monkeypatch.setattr(reports, "_KLL", 8)
    number = F.pmod(F.hash("id"), F.lit(5_000)).cast("double")
    odd = F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 101 == 0, float("nan"))
    df = spark.range(30_000).select(
        F.when(F.col("id") < 40, F.lit(9)).otherwise(F.col("id") % 3).alias("k"),
        odd.otherwise(number).alias("v"), "id",
    ).repartition(6)
    order = F.col("v").desc_nulls_last() if descending else F.col("v").asc_nulls_last()
    want = reports.top_per_snapshot(df, "k", [order, F.col("id").asc()], 201, 400)
    got = reports.deep_slice(df, "k", "v", ["id"], 201, 400, descending)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_undeclared_fields_are_listed_with_their_types(spark):
    texts = ['{"a": 1, "b": "x", "c": null}', '{"a": 2, "d": [1]}', '{"b": "y"}', "[1]", "bad", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = {tuple(r) for r in nested.undeclared_fields(df, "t", ["d"]).collect()}
    assert found == {("a", "BIGINT", 2, 3), ("b", "STRING", 2, 3), ("c", "VOID", 1, 3)}
    assert nested.undeclared_fields(df.filter("false"), "t", []).count() == 0


def test_summaries_of_parts_merge_to_the_overview(spark):
    df = spark.range(5_000).select(
        (F.col("id") % 700).alias("k"), F.timestamp_seconds(F.col("id") % 900 * 60).alias("t"))
    parts = [df.filter(F.pmod(F.hash("k", "t"), F.lit(3)) == i) for i in range(3)]
    notes = reports.summary(parts[0], "k", "t")
    for part in parts[1:]:
        notes = notes.unionByName(reports.summary(part, "k", "t"))
    got, want = reports.merged_overview(notes).first(), reports.data_overview(df, "k", "t").first()
    assert got["rows"] == 5_000 and all(got[c] == want[c] for c in want.__fields__)
    # The stated error: 0.1 percent is one standard error at any number of values.
    many = spark.range(400_000).select(F.col("id").alias("k"), F.timestamp_seconds("id").alias("t"))
    keys = reports.merged_overview(reports.summary(many, "k", "t")).first()["keys"]
    assert abs(keys / 400_000 - 1) < 0.004
