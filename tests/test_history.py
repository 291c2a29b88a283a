import bisect
import math
import random
from datetime import datetime, timedelta
from statistics import stdev

import pytest
from pyspark.sql import functions as F

from tidemark.functions import series
from tidemark.operators.history import (
    Timeline, _with_part, find_cut_points, first_value, key_aggregate, over_history,
)
from tidemark.plans.layers import GOLD_LOOK_BACK, rebased, to_gold
from tidemark.sources.schemas import GOLD_FEATURES

TL = Timeline("k", "t", ("id",))
START = datetime(2024, 1, 1)
DDL = "id INT, k STRING, t TIMESTAMP, v DOUBLE, s DOUBLE"


def one_key(spark, values, key="a"):
    rows = [(i, key, START + timedelta(minutes=i), v, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, DDL)


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def close(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g is None) == (w is None), (got, want)
        if w is not None:
            assert g == pytest.approx(w, rel=1e-9, abs=1e-9), (got, want)


def test_percent_change_does_not_fill_and_survives_zero(spark):
    w = TL.window()
    change = lambda vs: column(
        one_key(spark, vs).withColumn("c", series.pct_change(F.col("v"), w)), "c"
    )
    close(change([10.0, 11.0, None, 12.0]), [None, 10.0, None, None])
    close(change([12.0, 0.0, 5.0]), [None, -100.0, None])


def test_differences_means_and_deviations(spark):
    w = TL.window()
    df = one_key(spark, [10.0, 11.0, None, 12.0, 0.0, 5.0]).withColumns({
        "d": series.difference(F.col("v"), w),
        "m": series.rolling(F.col("v"), 3, w),
        "sd": series.rolling(F.col("v"), 3, w, F.stddev_samp, min_periods=2),
        "n2": series.rolling(F.col("v"), 3, w, F.sum, min_periods=3),
    })
    close(column(df, "d"), [None, 1, None, None, -12, 5])
    close(column(df, "m"), [10, 10.5, 10.5, 11.5, 6, 17 / 3])
    close(column(df, "sd"), [None, stdev([10, 11]), stdev([10, 11]), stdev([11, 12]),
                             stdev([12, 0]), stdev([12, 0, 5])])
    close(column(df, "n2"), [None, None, None, None, None, 17])


def test_minutes_keep_their_fraction(spark):
    rows = [(0, "a", START, 1.0, 1.0), (1, "a", START + timedelta(days=2, seconds=30.5), 1.0, 1.0)]
    df = spark.createDataFrame(rows, DDL)
    got = column(df.withColumn("m", series.minutes_since_last(F.col("t"), TL.window())), "m")
    close(got, [None, 2880 + 30.5 / 60])


def brute_force(rows):
    """The gold columns by plain loops over one key's ordered rows."""
    out, logs = {}, []
    for i, (rid, _, t, v, s) in enumerate(rows):
        p = rows[i - 1] if i else None
        change = log = minutes = shift = None
        if p is not None:
            minutes = (t - p[2]).total_seconds() / 60 if t and p[2] else None
            change = (v / p[3] - 1) * 100 if v is not None and p[3] else None
            shift = s - p[4] if s is not None and p[4] is not None else None
        if change is not None and 1 + change / 100 > 0:
            log = math.log(1 + change / 100)
        logs.append(log)

        def mean(n, i=i):
            seen = [r[3] for r in rows[max(0, i - n + 1): i + 1] if r[3] is not None]
            return sum(seen) / len(seen) if seen else None

        recent = [x for x in logs[-3:] if x is not None]
        out[rid] = (change, minutes, log, mean(3), mean(7),
                    stdev(recent) if len(recent) > 1 else None, shift)
    return out


def skewed_rows(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(1500):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "d", None, None])
        value = None if rng.random() < 0.05 else rng.choice([0.0, *[rng.uniform(1, 50)] * 9])
        if rng.random() < 0.02:
            when = None
        else:  # bursts of equal times, and one row far from all others
            when = START + timedelta(minutes=rng.choice([5, 5, 5, rng.randint(0, 9000)]))
        if i == 3:
            when = datetime(1971, 1, 1)
        rows.append((i, key, when, value, rng.uniform(0, 100)))
    return rows


@pytest.mark.parametrize("rows_per_part", [7, 60, 400])
def test_cut_histories_give_the_uncut_results(spark, rows_per_part):
    rows = skewed_rows(rows_per_part)
    df = spark.createDataFrame(rows, DDL)
    cuts = find_cut_points(df, TL, rows_per_part)
    assert cuts is not None and cuts.most_cuts >= 1
    got = to_gold(df, TL, "v", "s", cuts).collect()
    assert sorted(r["id"] for r in got) == list(range(len(rows)))

    want = {}
    far = datetime(9999, 1, 1)
    for key in {r[1] for r in rows} - {None}:
        mine = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2] or far, r[0]))
        want.update(brute_force(mine))
    for r in got:
        expected = want.get(r["id"], (None,) * 7)
        close([r[c] for c in GOLD_FEATURES], list(
            (expected[0], expected[1], expected[2], expected[3], expected[4], expected[5],
             expected[6])
        ))

    plain = rebased(df, TL, "v", None).select("id", "rebased")
    cut = rebased(df, TL, "v", None, cuts=cuts).select("id", "rebased")
    assert plain.exceptAll(cut).isEmpty() and cut.exceptAll(plain).isEmpty()


@pytest.mark.parametrize("kind", ["timestamp_ntz", "date", "bigint"])
def test_any_ordered_time_type_can_be_cut(spark, kind):
    rows = [r for r in skewed_rows(11) if r[2] is not None]
    df = spark.createDataFrame(rows, DDL)
    as_number = F.unix_seconds("t") if kind == "bigint" else F.col("t")
    df = df.withColumn("t", as_number.cast(kind))
    cuts = find_cut_points(df, TL, 50)

    def compute(d, w):
        return d.withColumn("m", series.rolling(F.col("v"), 7, w))

    plain = over_history(df, compute, TL, 6, ["v"]).filter("k IS NOT NULL")
    cut = over_history(df, compute, TL, 6, ["v"], cuts).filter("k IS NOT NULL")
    assert cut.count() == plain.count()
    assert plain.exceptAll(cut.select(*plain.columns)).isEmpty()


def test_rows_look_into_short_lists_only(spark):
    """Two levels: with m cuts of a key no row meets more than about the root of m of them."""
    df = spark.range(40_000).select(
        F.col("id").cast("int"), F.lit("hot").alias("k"),
        (F.lit(START) + F.make_interval(secs=F.col("id"))).alias("t"),
        F.lit(1.0).alias("v"), F.lit(1.0).alias("s"),
    )
    cuts = find_cut_points(df, TL, 10)
    many = cuts.chunks.agg(F.sum(F.size("_cuts"))).first()[0]
    assert many > 1000
    assert max(cuts.most_heads, cuts.most_cuts) < 2 * math.isqrt(many) + 2
    parts = _with_part(df, TL, cuts)
    assert set(parts.columns) == {*df.columns, "_part"}
    of_id = dict(parts.select("id", "_part").collect())
    starts = sorted(
        r["p"]["v0"] for r in cuts.chunks.select(F.explode("_cuts").alias("p")).collect())
    for i in range(0, 40_000, 997):
        at = int((START + timedelta(seconds=i) - datetime(1970, 1, 1)).total_seconds() * 1e6)
        assert of_id[i] == bisect.bisect_right(starts, at)


def test_rows_without_a_key_are_spread_even_if_of_one_time(spark):
    df = spark.range(5000).select(
        F.col("id").cast("int"), F.lit(None).cast("string").alias("k"),
        F.lit(START).alias("t"), F.lit(1.0).alias("v"), F.lit(1.0).alias("s"),
    )
    hot = df.withColumn("k", F.lit("hot"))
    cuts = find_cut_points(hot.unionByName(df), TL, 100)
    parts = _with_part(df, TL, cuts)
    assert parts.select("_part").distinct().count() > 500


def test_small_tables_are_not_cut(spark):
    df = one_key(spark, [1.0, 2.0])
    assert find_cut_points(df, TL) is None


def test_tables_without_a_hot_key_are_not_cut(spark):
    df = spark.range(2000).select(
        F.col("id").cast("int"), F.col("id").cast("string").alias("k"),
        F.lit(START).alias("t"), F.lit(1.0).alias("v"), F.lit(1.0).alias("s"),
    )
    assert find_cut_points(df, TL, 200) is None


def test_parts_are_of_bounded_size(spark):
    df = spark.range(20_000).select(
        F.col("id").cast("int"), F.lit("hot").alias("k"),
        (F.lit(START) + F.make_interval(secs=F.col("id"))).alias("t"),
        F.lit(1.0).alias("v"), F.lit(1.0).alias("s"),
    )
    cuts = find_cut_points(df, TL, 1000)

    def sizes(rows, w):
        return rows.withColumn("n", F.row_number().over(w))

    most = over_history(df, sizes, TL, 0, [], cuts).agg(F.max("n")).first()[0]
    assert most < 2000


def test_a_masked_null_key_is_spread_out(spark):
    df = spark.range(3000).select(
        F.col("id").cast("int"), F.lit(None).cast("string").alias("k"),
        F.lit(START).alias("t"), F.lit(1.0).alias("v"), F.lit(1.0).alias("s"),
    )
    cuts = find_cut_points(df, TL, 100)
    got = to_gold(df, TL, "v", "s", cuts)
    assert got.count() == 3000
    assert got.filter(F.col("price_sma_3").isNotNull()).isEmpty()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gold_needs_one_shuffle_one_sort_and_no_python(spark):
    plan = plan_of(to_gold(one_key(spark, [1.0, 2.0]), TL, "v", "s"))
    assert plan.count("Exchange") == 1
    assert plan.count("Sort ") == 1
    assert plan.count("- Window [") == 2
    assert "Python" not in plan


def test_cut_gold_shuffles_whole_rows_once(spark):
    df = spark.createDataFrame(skewed_rows(1), DDL)
    plan = plan_of(to_gold(df, TL, "v", "s", find_cut_points(df, TL, 60)))
    assert plan.count("REPARTITION_BY_COL") == 1
    # The other two shuffles carry part ends only, cut down before they travel.
    assert plan.count("ENSURE_REQUIREMENTS") == 2
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert "Python" not in plan


def test_a_key_filter_passes_below_the_windows(spark, tmp_path):
    path = str(tmp_path / "t")
    one_key(spark, [1.0, 2.0]).write.parquet(path)
    gold = to_gold(spark.read.parquet(path), TL, "v", "s")
    plan = plan_of(gold.filter("k = 'a'").select("price_sma_3"))
    assert "EqualTo(k,a)" in plan
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "s:double" not in scan.split("ReadSchema")[1]


def test_properties_of_the_features(spark):
    rng = random.Random(3)
    prices = [rng.uniform(1, 100) for _ in range(200)]
    gold = to_gold(one_key(spark, prices), TL, "v", "s").orderBy("id").collect()
    assert sum(r["observed_log_return"] or 0 for r in gold) == pytest.approx(
        math.log(prices[-1] / prices[0])
    )
    assert gold[0]["price_delta_pct"] is None and gold[0]["minutes_since_last"] is None
    assert [r["volatility_3"] is None for r in gold[:3]] == [True, True, False]
    for i, r in enumerate(gold):
        frame = prices[max(0, i - 6): i + 1]
        assert min(frame) - 1e-9 <= r["price_sma_7"] <= max(frame) + 1e-9
    assert GOLD_LOOK_BACK == 6


def test_first_value_takes_the_first_row_even_if_null(spark):
    df = one_key(spark, [None, 2.0])
    assert column(key_aggregate(df, first_value("v", TL, df), TL, "f"), "f") == [None, None]


@pytest.mark.parametrize("rows_per_part", [7, 400])
def test_aggregates_of_cut_keys_cover_the_whole_key(spark, rows_per_part):
    df = spark.createDataFrame(skewed_rows(5), DDL)
    cuts = find_cut_points(df, TL, rows_per_part)
    plain = key_aggregate(df, F.max("s"), TL, "m")
    cut = key_aggregate(df, F.max("s"), TL, "m", cuts)
    assert plain.exceptAll(cut).isEmpty() and cut.exceptAll(plain).isEmpty()
    plan = plan_of(cut)
    assert "SortMergeJoin" not in plan and "partial_max" in plan
