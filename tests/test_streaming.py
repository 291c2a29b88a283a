import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.test_layers import END, coin, payload, put
from tidemark.operators import dedup
from tidemark.operators.history import Timeline
from tidemark.plans import jobs
from tidemark.plans.jobs import Layers
from tidemark.sources import files
from tidemark.sources.landing import read_payloads
from tidemark.sources.schemas import GOLD, SILVER, with_batch
from tidemark.streaming import jobs as streams


@pytest.fixture
def landing(tmp_path):
    return tmp_path / "landing"


@pytest.fixture
def layers(tmp_path):
    return Layers(str(tmp_path / "live"))


def catch_up(spark, landing, layers, **gold):
    streams.bronze_stream(spark, str(landing), layers, END).awaitTermination()
    streams.silver_stream(spark, layers).awaitTermination()
    streams.gold_stream(spark, layers, **gold).awaitTermination()


def snapshot(hour, day=22):
    coins = [coin("BTC", 100.0 + hour * day % 17, market_cap_dominance=40.0 + hour)]
    if hour % 3:
        coins.append(coin("ETH", 10.0 + hour, 2))
    if hour == 4:
        coins.append(coin("BAD", -1.0))
    return payload(hour, *coins, day=day)


def rows(df, names):
    return sorted(([r[n] for n in names] for r in df.collect()), key=str)


def test_streams_give_the_batch_tables(spark, landing, layers, tmp_path):
    for hour in range(0, 8):
        put(landing, f"{hour:02d}.json", snapshot(hour))
    catch_up(spark, landing, layers)
    put(landing, "x-replay.json", snapshot(3))
    for hour in range(8, 16):
        put(landing, f"{hour:02d}.json", snapshot(hour))
    put(landing, "y-bad.json", "{nothing")
    catch_up(spark, landing, layers)
    catch_up(spark, landing, layers)

    batch = Layers(str(tmp_path / "batch"))
    jobs.run_cycle(spark, str(landing), batch, "b", END, mode="quarantine")
    assert rows(layers.read_silver(spark), SILVER.names) == rows(
        batch.read_silver(spark), SILVER.names)
    assert rows(streams.read_live_gold(spark, layers), GOLD.names) == rows(
        batch.read_gold(spark), GOLD.names)
    assert streams.read_late(spark, layers).count() == 0
    assert layers.read_audit(spark).count() == 18
    assert layers.read_audit(spark).filter("malformed").count() == 1
    assert spark.read.parquet(layers.quarantine).select("symbol").distinct().first()[0] == "BAD"


def same_gold(spark, layers):
    """Live Gold has the rows of a Gold rebuilt from the same Silver."""
    jobs.rebuild_gold(spark, layers)
    live = rows(streams.read_live_gold(spark, layers), GOLD.names)
    return live == rows(layers.read_gold(spark), GOLD.names)


def rewind(spark, layers, name, records=()):
    """The stream dies before ending its last micro-batch, or before leaving its record."""
    folder = f"{layers.checkpoint(name)}/commits"
    last = max((n for n in files.names(spark, folder) if n.isdigit()), key=int)
    for file in (last, f".{last}.crc"):
        files.delete(spark, f"{folder}/{file}")
    if name in records:
        files.delete(spark, f"{layers.commits(name)}/{streams._label(int(last))}.json")


@pytest.mark.parametrize("records", [(), ("bronze", "silver", "gold")])
def test_retried_micro_batches_change_nothing(spark, landing, layers, records):
    for hour in range(0, 4):
        put(landing, f"{hour:02d}.json", snapshot(hour))
    catch_up(spark, landing, layers)
    for hour in range(4, 8):
        put(landing, f"{hour:02d}.json", snapshot(hour))
    catch_up(spark, landing, layers)
    kept = {
        "bronze": layers.read_bronze(spark).drop("batch_id"),
        "silver": layers.read_silver(spark), "audit": layers.read_audit(spark),
    }
    kept = {name: rows(df, df.columns) for name, df in kept.items()}
    for name in ("bronze", "silver", "gold"):
        rewind(spark, layers, name, records)
        catch_up(spark, landing, layers)
        for table, before in kept.items():
            df = layers.read(spark, table)
            df = df.drop("batch_id") if table == "bronze" else df
            assert rows(df, df.columns) == before, (name, table)
        assert streams.read_late(spark, layers).count() == 0
        assert same_gold(spark, layers)
    put(landing, "08.json", snapshot(8))
    catch_up(spark, landing, layers)
    assert streams.read_late(spark, layers).count() == 0 and same_gold(spark, layers)


def test_late_rows_are_folded_into_live_gold(spark, landing, layers):
    for hour in (0, 1, 3):
        put(landing, f"{hour:02d}.json", snapshot(hour))
    catch_up(spark, landing, layers)
    put(landing, "02.json", snapshot(2))
    put(landing, "04.json", snapshot(4))
    catch_up(spark, landing, layers)
    late = streams.read_late(spark, layers)
    # ETH is missing at hours 0 and 3, so hour 2 is no earlier than what it has.
    assert {r["symbol"] for r in late.collect()} == {"BTC"}
    assert same_gold(spark, layers)
    put(landing, "05.json", snapshot(5))
    catch_up(spark, landing, layers)
    put(landing, "06.json", snapshot(1, day=21))
    catch_up(spark, landing, layers)
    rewind(spark, layers, "gold", ("gold",))
    catch_up(spark, landing, layers)
    assert same_gold(spark, layers)
    live = rows(streams.latest_gold(spark, layers), GOLD.names)
    assert live == rows(layers.read_gold(spark), GOLD.names)


def silver_frame(spark, landing, hours):
    for hour in hours:
        put(landing, f"{hour:02d}.json", snapshot(hour))
    files = [str(landing / f"{hour:02d}.json") for hour in hours]
    return jobs.to_bronze(read_payloads(spark, files)).transform(jobs.clean).select(*SILVER.names)


def test_streams_go_on_after_compaction(spark, landing, layers, tmp_path):
    """Gold takes batches that were merged before it came, and late rows of merged keys."""
    hours = [3, 4, 5, 8, 9]
    for hour in hours:
        put(landing, f"{hour:02d}.json", snapshot(hour))
    streams.bronze_stream(spark, str(landing), layers, END).awaitTermination()
    streams.silver_stream(spark, layers).awaitTermination()
    for _ in range(2):
        jobs.compact_silver(spark, layers)
    streams.gold_stream(spark, layers).awaitTermination()
    put(landing, "z-late.json", snapshot(7))
    catch_up(spark, landing, layers)
    batch = Layers(str(tmp_path / "batch"))
    jobs.run_cycle(spark, str(landing), batch, "b", END, mode="quarantine")
    assert rows(layers.read_silver(spark), SILVER.names) == rows(
        batch.read_silver(spark), SILVER.names)
    assert rows(streams.read_live_gold(spark, layers), GOLD.names) == rows(
        batch.read_gold(spark), GOLD.names)


def test_a_micro_batch_run_again_changes_nothing(spark, landing, layers):
    one = silver_frame(spark, landing, range(0, 9))
    two = silver_frame(spark, landing, range(9, 15))
    tl = Timeline()
    streams.advance_gold(one, layers, 0, tl, 1_000)
    streams.advance_gold(two, layers, 1, tl, 1_000)
    before = rows(streams.read_live_gold(spark, layers), GOLD.names)
    streams.advance_gold(two, layers, 1, tl, 1_000)
    assert rows(streams.read_live_gold(spark, layers), GOLD.names) == before
    assert streams.read_late(spark, layers).count() == 0


def test_a_micro_batch_with_a_hot_key_is_cut(spark, landing, layers, tmp_path):
    one = silver_frame(spark, landing, range(0, 9))
    two = silver_frame(spark, landing, range(9, 24))
    other = Layers(str(tmp_path / "other"))
    for target, part in ((layers, 4), (other, 1_000)):
        streams.advance_gold(one, target, 0, Timeline(), part)
        streams.advance_gold(two, target, 1, Timeline(), part)
    assert rows(streams.read_live_gold(spark, layers), GOLD.names) == rows(
        streams.read_live_gold(spark, other), GOLD.names)


def test_state_keeps_a_bounded_number_of_rows(spark, landing, layers):
    streams.advance_gold(silver_frame(spark, landing, range(0, 24)), layers, 0, Timeline(), 1_000)
    state = spark.read.parquet(f"{layers.live_state}/batch_id={streams._label(0)}")
    assert state.groupBy("symbol").count().agg(F.max("count")).first()[0] == 7


def files_below(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_a_batch_leaves_the_state_of_other_keys_alone(spark, landing, layers):
    """Buckets without new rows keep their files; replaced ones go two batches later."""
    def one(symbol, hour):
        put(landing, f"{symbol}{hour}.json", payload(hour, coin(symbol, 10.0 + hour)))
        path = str(landing / f"{symbol}{hour}.json")
        return jobs.to_bronze(read_payloads(spark, [path])).transform(jobs.clean).select(
            *SILVER.names)

    both = one("BTC", 0).unionByName(one("ETH", 0))
    streams.advance_gold(both, layers, 0, Timeline(), 1_000, buckets=64)
    first = files_below(layers.live_state)
    assert len({p.split("bucket=")[1].split("/")[0] for p in first}) == 2
    streams.advance_gold(one("BTC", 1), layers, 1, Timeline(), 1_000, buckets=64)
    second = files_below(layers.live_state)
    assert {p: second[p] for p in first} == first
    assert len(second) == len(first) + 1
    streams.advance_gold(one("BTC", 2), layers, 2, Timeline(), 1_000, buckets=64)
    third = files_below(layers.live_state)
    assert len(third) == len(second)  # BTC's bucket of batch 0 is gone, ETH's is untouched
    assert len([p for p in third if p in first]) == 1
    streams.advance_gold(one("ETH", 3), layers, 3, Timeline(), 1_000, buckets=64)
    live = streams.read_live_gold(spark, layers).filter("symbol = 'ETH'")
    assert sorted(r["minutes_since_last"] or 0 for r in live.collect()) == [0, 180]


def test_a_late_row_writes_again_only_what_looks_back_on_it(spark, landing, layers):
    for hour in [*range(0, 5), *range(6, 20)]:
        put(landing, f"{hour:02d}.json", snapshot(hour))
    catch_up(spark, landing, layers)
    put(landing, "x.json", snapshot(5))
    catch_up(spark, landing, layers)
    assert same_gold(spark, layers)
    written = spark.read.parquet(layers.live_gold)
    last = written.agg(F.max("batch_id")).first()[0]
    again = written.filter(F.col("batch_id") == last).groupBy("symbol").count().collect()
    # The late row and the six behind it, of one or two coins.
    assert {r["symbol"]: r["count"] for r in again} == {"BTC": 7, "ETH": 7}


def test_late_rows_with_few_rows_before_them_are_looked_for_in_all_dates(spark, landing, layers):
    for day in (1, 2, 3, 25, 26, 28):
        put(landing, f"{day}.json", snapshot(1, day=day))
    catch_up(spark, landing, layers)
    put(landing, "x.json", snapshot(1, day=27))
    catch_up(spark, landing, layers)
    assert same_gold(spark, layers)


@pytest.mark.parametrize("shares", [1, 4])
def test_replays_within_the_lateness_are_dropped(spark, tmp_path, shares):
    src, out = tmp_path / "in", str(tmp_path / "out")
    for name in ("a", "b", "c"):
        copies = [json.dumps({"k": 7, "t": "2026-01-01T00:07:00Z"})] * 50
        put(src, f"{name}.json", "\n".join(copies + [
            json.dumps({"k": k, "t": f"2026-01-01T00:{k:02d}:00Z"}) for k in range(30)]))
    stream = spark.readStream.schema("k INT, t TIMESTAMP").option("maxFilesPerTrigger", 1)
    kept = dedup.drop_replays(stream.json(str(src)), ["k", "t"], "t", "1 hour", shares)
    (kept.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(out).awaitTermination())
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == list(range(30))


@pytest.mark.parametrize("keys", [["k", "t"], ["t", "k"]])
def test_of_differing_copies_in_any_order_the_first_stays(spark, tmp_path, keys):
    """Copies differ and arrive in reverse; nulls are equal as keys and last as order."""
    src, out = tmp_path / "in", str(tmp_path / "out")
    for place in (3, 2, 1, None):
        lines = [
            json.dumps({"k": k or None, "t": f"2026-01-01T00:{k:02d}:00Z", "n": place, "v": f"{place}"})
            for k in range(20)
        ]
        put(src, f"{9 - (place or 9)}.json", "\n".join(lines * (40 if place == 2 else 1)))
    put(src, "z.json", json.dumps({"k": 99, "t": "2026-01-02T00:00:00Z", "n": 1, "v": "later"}))
    late = json.dumps({"k": 5, "t": "2026-01-01T00:05:00Z", "n": 0, "v": "too late"})
    stream = spark.readStream.schema("k INT, t TIMESTAMP, n INT, v STRING")
    stream = stream.option("maxFilesPerTrigger", 1)
    kept = dedup.first_arrivals(stream.json(str(src)), keys, ["n"], "t", "1 hour")
    assert kept.columns == ["k", "t", "n", "v"]
    for _ in range(2):
        (kept.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True).start(out).awaitTermination())
        put(src, "zz.json", late)
    found = spark.read.parquet(out).collect()
    assert len(found) == 20 and {r["v"] for r in found} == {"1"}


def test_first_arrivals_need_the_time_among_the_keys(spark):
    df = spark.createDataFrame([], "k INT, t TIMESTAMP")
    with pytest.raises(ValueError):
        dedup.first_arrivals(df, ["k"], ["k"], "t", "1 hour")


def test_polling_streams_pick_up_what_lands(spark, landing, layers):
    put(landing, "00.json", snapshot(0))
    queries = streams.start_all(spark, str(landing), layers, END, "200 milliseconds")
    try:
        for query in queries:
            query.processAllAvailable()
        put(landing, "01.json", snapshot(1))
        for query in queries:
            query.processAllAvailable()
    finally:
        for query in queries:
            query.stop()
    live = streams.read_live_gold(spark, layers)
    assert sorted(r["symbol"] for r in live.collect()) == ["BTC", "BTC", "ETH"]
    change = live.filter("price_delta_pct IS NOT NULL").collect()
    assert [(r["symbol"], r["minutes_since_last"]) for r in change] == [("BTC", 60.0)]


def test_tables_without_rows_cost_no_tasks(spark, layers, capsys):
    """Those of the first batch, which would start Python workers for nothing."""
    silver = layers.read_batches(spark, "silver", SILVER, [])
    both = silver.unionByName(spark.range(3).select("*"), allowMissingColumns=True)
    both.explain()
    plan = capsys.readouterr().out
    assert "ExistingRDD" not in plan and "Union" not in plan and "Range" in plan
    assert both.count() == 3 and silver.schema.names == with_batch(SILVER).names
