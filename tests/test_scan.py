import math
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_history import DDL, START, TL, close, column
from tidemark.operators.history import carried_forward, find_cut_points, with_rank
from tidemark.operators.scan import linear_scan
from tidemark.plans import indicators
from tidemark.plans.layers import to_gold

VALUES = {"mixed": 900, "short": 3, "gone": 5}


@pytest.fixture(scope="module")
def rows(spark):
    """A long key, a short one, one without values, and rows without a key; nulls and ties."""
    rng, made, n = random.Random(8), [], 0
    for key, count in VALUES.items():
        for i in range(count):
            t = START + timedelta(minutes=i // 2 * 2 if i % 7 else i)
            gap = 300 <= i < 480 or rng.random() < 0.2 or key == "gone"
            v = None if gap else rng.uniform(1, 100)
            made.append((n, key, t, v, v))
            n += 1
    made += [(n + i, None, START, 5.0, 5.0) for i in range(4)]
    return spark.createDataFrame(made, DDL).repartition(7)


@pytest.fixture(scope="module")
def cuts(rows):
    found = find_cut_points(rows, TL, rows_per_part=60)
    assert found is not None and found.most_cuts > 1
    return found


def histories(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r["t"], r["id"])):
        out.setdefault(r["k"], []).append(r)
    return out


def by_id(df, name):
    return {r["id"]: r[name] for r in df.collect()}


def check(got, want):
    assert set(got) == set(want)
    ids = sorted(got)
    close([got[i] for i in ids], [want[i] for i in ids])


@pytest.mark.parametrize("cut", [False, True])
def test_a_scan_equals_the_loop(rows, cuts, cut):
    steps = {
        "sum": (F.lit(1.0), F.col("v")),
        "ema": (F.when(F.col("v").isNotNull(), F.lit(0.9)), F.col("v") * 0.1, F.col("v")),
    }
    got = linear_scan(rows, steps, TL, cuts if cut else None)
    assert got.columns == [*rows.columns, "sum", "ema"]
    sums, means = {}, {}
    for key, history in histories(rows).items():
        total, mean = 0.0, None
        for r in history:
            if r["v"] is not None:
                total += r["v"]
                mean = r["v"] if mean is None else 0.9 * mean + 0.1 * r["v"]
            sums[r["id"]], means[r["id"]] = (total, mean) if key else (None, None)
    check(by_id(got, "sum"), sums)
    check(by_id(got, "ema"), means)


@pytest.mark.parametrize("cut", [False, True])
def test_ranks_and_carried_values_equal_the_loop(rows, cuts, cut):
    points = cuts if cut else None
    ranks, counts, last = {}, {}, {}
    for key, history in histories(rows).items():
        seen, value = 0, None
        for i, r in enumerate(history):
            seen += r["v"] is not None
            value = value if r["v"] is None else r["v"]
            if key:
                ranks[r["id"]], counts[r["id"]] = i + 1, seen
            last[r["id"]] = value if key else None
    got = with_rank(rows, TL, "n", points).filter("k IS NOT NULL")
    assert by_id(got, "n") == ranks
    got = with_rank(rows, TL, "n", points, F.col("v")).filter("k IS NOT NULL")
    assert by_id(got, "n") == counts
    check(by_id(carried_forward(rows, "v", TL, "f", points), "f"), last)


@pytest.mark.parametrize("cut", [False, True])
def test_indicators_equal_their_definitions(rows, cuts, cut):
    points = cuts if cut else None
    signal, strength = {}, {}
    for key, history in histories(rows).items():
        fast = slow = mark = None
        gains = losses = None
        changes, before = [], None
        for r in history:
            v = r["v"]
            if v is not None:
                fast = v if fast is None else fast * 11 / 13 + v * 2 / 13
                slow = v if slow is None else slow * 25 / 27 + v * 2 / 27
                mark = fast - slow if mark is None else mark * 0.8 + (fast - slow) * 0.2
            if v is not None and before is not None:
                changes.append(v - before)
                up, down = max(changes[-1], 0), max(-changes[-1], 0)
                if len(changes) == 14:
                    gains = sum(max(c, 0) for c in changes) / 14
                    losses = sum(max(-c, 0) for c in changes) / 14
                elif len(changes) > 14:
                    gains, losses = (gains * 13 + up) / 14, (losses * 13 + down) / 14
            before = v
            signal[r["id"]] = mark if key else None
            known = key and gains is not None and gains + losses > 0
            strength[r["id"]] = 100 * gains / (gains + losses) if known else None
    check(by_id(indicators.macd(rows, "v", TL, points), "macd_signal"), signal)
    check(by_id(indicators.wilder_rsi(rows, "v", TL, points), "rsi"), strength)


def test_percent_changes_carry_values_over_gaps(spark):
    def changes(values):
        made = [(i, "a", START + timedelta(minutes=i), v, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(made, DDL)
        return column(indicators.filled_pct_change(df, "v", TL, out="c"), "c")

    # The table of edge cases.
    close(changes([10.0, 11.0, None, 12.0]), [None, 10.0, 0.0, (12 / 11 - 1) * 100])
    close(changes([None, None, 5.0, None]), [None, None, None, 0.0])


@pytest.mark.parametrize("cut", [False, True])
def test_gold_with_carried_values_differs_in_changes_only(rows, cuts, cut):
    gold = to_gold(rows, TL, "v", "s", cuts if cut else None, fill=True)
    plain = to_gold(rows, TL, "v", "s")
    assert gold.columns == plain.columns
    check(by_id(gold, "price_sma_7"), by_id(plain, "price_sma_7"))
    want = {}
    for key, history in histories(rows).items():
        before = None
        for r in history:
            now = before if r["v"] is None else r["v"]
            known = key and before and now is not None
            want[r["id"]] = (now / before - 1) * 100 if known else None
            before = now
    check(by_id(gold, "price_delta_pct"), want)


def test_bands_and_anomalies(spark):
    values = [10.0, 12.0, 11.0, 13.0, 10.0, 12.0, 60.0, None, 11.0]
    made = [(i, "a", START + timedelta(minutes=i), v, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(made, DDL)
    bands = indicators.bollinger(df, "v", TL, rows=4)
    mean, spread = 11.5, math.sqrt(sum((x - 11.5) ** 2 for x in values[:4]) / 4)
    close(column(bands, "band_high")[:4], [None, None, None, mean + 2 * spread])
    close(column(bands, "band_low")[3:4], [mean - 2 * spread])
    flags = column(indicators.anomalies(df, "v", TL, rows=6), "is_anomaly")
    assert flags == [False] * 6 + [True, False, False]
