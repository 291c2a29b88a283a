import random

import pytest
from pyspark.sql import functions as F

from tests.test_layers import END, coin, payload, put
from tests.test_streaming import snapshot
from tidemark.operators.history import Timeline
from tidemark.plans import jobs
from tidemark.plans.jobs import Layers
from tidemark.plans.layers import rebased
from tidemark.sources.schemas import GOLD, GOLD_FEATURES, SILVER
from tidemark.streaming import jobs as streams
from tidemark.streaming import stateful

HOUR = 3_600_000
KEY = ["symbol", "collected_at"]


@pytest.fixture
def landing(tmp_path):
    return tmp_path / "landing"


@pytest.fixture
def layers(tmp_path):
    return Layers(str(tmp_path / "live"))


def catch_up(spark, landing, layers, **settings):
    streams.bronze_stream(spark, str(landing), layers, END).awaitTermination()
    streams.silver_stream(spark, layers).awaitTermination()
    stateful.stateful_gold_stream(spark, layers, **settings).awaitTermination()


def close(df, names):
    out = []
    for r in df.select(*names).collect():
        out.append(tuple(round(v, 9) if isinstance(v, float) else v for v in r))
    return sorted(out, key=repr)


def same_as_batch(spark, layers):
    jobs.rebuild_gold(spark, layers)
    live = stateful.read_stateful_gold(spark, layers).filter("NOT too_late")
    assert close(live, GOLD.names) == close(layers.read_gold(spark), GOLD.names)
    base = rebased(layers.read_silver(spark))
    plain = live.filter("NOT is_stablecoin")
    assert close(plain, [*KEY, "rebased"]) == close(base, [*KEY, "rebased"])


def test_stateful_gold_equals_batch_gold(spark, landing, layers):
    provider = spark.conf.get(stateful.PROVIDER, None)
    for hours in (range(0, 8), range(8, 10), range(10, 24)):
        for hour in hours:
            coins = [coin("USDT", 1.0 + hour / 100), coin("BTC", 100.0 + hour * 7 % 5)]
            put(landing, f"{hour:02d}.json", payload(hour, *coins))
            put(landing, f"x{hour:02d}.json", snapshot(hour, day=23))
        catch_up(spark, landing, layers)
    same_as_batch(spark, layers)
    assert spark.conf.get(stateful.PROVIDER, None) == provider


def test_late_rows_change_what_looks_back_on_them(spark, landing, layers):
    hours = list(range(24))
    random.Random(3).shuffle(hours)
    for i in range(0, 24, 6):
        for hour in hours[i : i + 6]:
            put(landing, f"{hour:02d}.json", snapshot(hour))
        catch_up(spark, landing, layers, files_per_trigger=3)
    same_as_batch(spark, layers)
    assert stateful.read_stateful_gold(spark, layers).filter("too_late").count() == 0


def test_rows_beyond_the_lateness_are_marked_and_change_nothing(spark, landing, layers):
    for hour in range(4, 24):
        put(landing, f"{hour:02d}.json", snapshot(hour))
    catch_up(spark, landing, layers, lateness_ms=2 * HOUR)
    before = close(stateful.read_stateful_gold(spark, layers), stateful.LIVE.names)
    put(landing, "01.json", snapshot(1))
    catch_up(spark, landing, layers, lateness_ms=2 * HOUR)
    after = stateful.read_stateful_gold(spark, layers)
    late = after.filter("too_late").collect()
    assert {r["symbol"] for r in late} == {"BTC", "ETH"}
    assert all(r[c] is None for r in late for c in GOLD_FEATURES)
    assert close(after.filter("NOT too_late"), stateful.LIVE.names) == before
    put(landing, "30.json", snapshot(1, day=23))
    catch_up(spark, landing, layers, lateness_ms=2 * HOUR)
    jobs.rebuild_gold(spark, layers)
    # Rows that look back on six rows behind the late one are as in batch.
    since = F.col("collected_at") >= F.lit("2026-05-22T12:00:00+00:00").cast("timestamp")
    live = stateful.read_stateful_gold(spark, layers).filter("NOT too_late").filter(since)
    assert close(live, GOLD.names) == close(layers.read_gold(spark).filter(since), GOLD.names)


def test_a_batch_writes_the_state_of_its_own_keys_only(spark, landing, layers):
    put(landing, "0.json", payload(0, coin("BTC", 1.0), coin("ETH", 2.0)))
    catch_up(spark, landing, layers)
    put(landing, "1.json", payload(1, coin("BTC", 3.0)))
    catch_up(spark, landing, layers)
    progress = []
    put(landing, "2.json", payload(2, coin("BTC", 4.0)))
    streams.bronze_stream(spark, str(landing), layers, END).awaitTermination()
    streams.silver_stream(spark, layers).awaitTermination()
    query = stateful.stateful_gold_stream(spark, layers)
    query.awaitTermination()
    for p in query.recentProgress:
        progress += [op["customMetrics"] for op in p["stateOperators"] if p["numInputRows"]]
    assert progress and all("rocksdbPutCount" in m or "rocksdbTotalBytesWritten" in m for m in progress)
    updated = [
        op["numRowsUpdated"] for p in query.recentProgress for op in p["stateOperators"]
        if p["numInputRows"]
    ]
    # BTC's rows and its notes; nothing of ETH.
    assert sum(updated) <= 8


def test_state_is_bounded_by_the_lateness():
    rows = []

    class Store:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value if self.value is not None else iter(())

        def put(self, value):
            self.value = value

        update = put

    class Handle:
        def getListState(self, *_):
            return Store()

        getValueState = getListState

    made = stateful._Features(
        SILVER, Timeline(), "quote_USD_price", None, None, 2 * HOUR)
    made.init(Handle())
    at = SILVER.names.index("collected_at")
    for n in range(200):
        row = [None] * len(SILVER.names)
        row[at], row[SILVER.names.index("quote_USD_price")] = n * HOUR * 1000, 1.0 + n
        list(made.handleInputRows(("BTC",), [tuple(row)], None))
        rows.append(len(made.recent.value))
    assert max(rows) == 9  # those within two hours, and six before them


def test_a_key_costs_three_calls_of_its_state_and_three_columns():
    """A call is a message to another process, and so is every column of a row and of a batch."""
    calls = []

    class Store:
        value = None

        def exists(self):
            calls.append("exists")
            return self.value is not None

        def get(self):
            calls.append("get")
            return self.value

        def put(self, value):
            calls.append("put")
            self.value = value

        update = put

    class Handle:
        def getListState(self, *_):
            return Store()

        getValueState = getListState

    made = stateful._Features(SILVER, Timeline(), "quote_USD_price", None, None, 9 * HOUR)
    made.init(Handle())
    at = SILVER.names.index("collected_at")
    for n in range(4):
        row = [None] * len(SILVER.names)
        row[at], row[SILVER.names.index("quote_USD_price")] = n * HOUR * 1000, 1.0 + n
        calls.clear()
        (out,) = made.handleInputRows(("BTC",), [tuple(row)], None)
        assert len(calls) <= 3 and len(out) == 3
    assert out[1][0] == pytest.approx(100 / 3) and out[1][-1] == 400.0 and out[2] is False


def test_rows_pass_the_state_unchanged(spark, landing, layers):
    """Texts that need escapes, numbers that need all digits, and infinite ones."""
    odd = coin("A\"\\\u00e9\n", 0.1 + 0.2)
    odd["name"], odd["circulating_supply"] = "", 1e-310
    put(landing, "0.json", payload(0, odd, coin("B", 1.7976931348623157e308)))
    catch_up(spark, landing, layers)
    live = stateful.read_stateful_gold(spark, layers).select(*SILVER.names)
    assert sorted(live.collect()) == sorted(layers.read_silver(spark).select(*SILVER.names).collect())
