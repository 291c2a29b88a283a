import json
import math
import os
from datetime import date, datetime
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import reports
from tidemark.operators.quality import QualityError, snapshot_checks
from tidemark.plans import jobs
from tidemark.plans.jobs import Layers
from tidemark.plans.layers import clean, silver_increment, to_audit, to_bronze, to_silver
from tidemark.sources import files, tables
from tidemark.sources.landing import read_payloads
from tidemark.sources.schemas import (
    AUDIT, BRONZE, COIN, GOLD, GOLD_FEATURES, ORIGIN, SILVER, further_fields,
)

END = "landing/listings"


def coin(symbol, price, rank=1, platform=None, **quote):
    usd = {
        "price": price, "percent_change_1h": 10.0, "percent_change_24h": -100.0,
        "percent_change_7d": None, "market_cap": 1000.0, "volume_24h": 50.0,
        "market_cap_dominance": 40.0, "last_updated": "2026-05-22T14:16:00.000Z", **quote,
    }
    return {
        "symbol": symbol, "name": symbol.title(), "cmc_rank": rank, "circulating_supply": 21.0,
        "max_supply": None if symbol == "ETH" else 42.0, "date_added": "2013-04-28T00:00:00.000Z",
        "last_updated": "junk", "platform": platform, "quote": {"USD": usd}, "tags": ["x"],
    }


def payload(hour, *coins, day=22):
    return {
        "status": {"credit_count": 1, "total_count": 9000, "elapsed": 12, "notice": None},
        "data": list(coins),
        "collected_at": f"2026-05-{day:02d}T{hour:02d}:17:13+00:00",
    }


def put(folder, name, content):
    folder.mkdir(exist_ok=True)
    text = content if isinstance(content, str) else json.dumps(content, indent=2)
    (folder / name).write_text(text)


@pytest.fixture
def landing(tmp_path):
    return tmp_path / "landing"


@pytest.fixture
def layers(tmp_path):
    return Layers(str(tmp_path / "layers"))


def test_bronze_is_flat_and_has_every_declared_column(spark, landing):
    put(landing, "a.json", payload(14, coin("BTC", 1.0), coin("USDT", 1.0, platform={"id": 1027})))
    bronze = to_bronze(read_payloads(spark, str(landing)))
    assert bronze.schema.names == BRONZE.names
    got = {r["symbol"]: r for r in bronze.collect()}
    assert got["BTC"]["platform_id"] is None and got["USDT"]["platform_id"] == 1027
    assert got["BTC"]["quote_USD_price"] == 1.0
    assert got["BTC"]["collected_at"] == "2026-05-22T14:17:13+00:00"
    assert got["BTC"]["snapshot_date"] == date(2026, 5, 22)
    assert (got["BTC"]["listing_position"], got["USDT"]["listing_position"]) == (0, 1)


def test_payloads_of_native_coins_only_still_have_the_platform_column(spark, landing):
    put(landing, "a.json", payload(14, coin("BTC", 1.0)))
    silver = to_silver(to_bronze(read_payloads(spark, str(landing))))
    assert [r["is_token"] for r in silver.collect()] == [False]


def test_unlisted_fields_can_be_kept(spark, landing):
    put(landing, "a.json", payload(14, coin("BTC", 1.0)))
    wider = T.StructType([*COIN.fields, T.StructField("tags", T.ArrayType(T.StringType()))])
    typed = to_bronze(read_payloads(spark, str(landing), coin=wider)).first()
    assert typed["tags"] == ["x"] and typed["raw_json"] is None
    row = to_bronze(read_payloads(spark, str(landing)), wider).first()
    assert row["tags"] == ["x"]
    assert json.loads(row["raw_json"])["tags"] == ["x"]
    assert {**row.asDict(), "raw_json": None} == typed.asDict()


def test_no_field_of_the_payload_is_lost_in_a_cycle(spark, landing, layers):
    listing = {**coin("BTC", 1.0), "slug": "bitcoin", "num_market_pairs": 7}
    status = {"credit_count": 1, "error_code": 1008, "error_message": "too many calls"}
    put(landing, "a.json", {**payload(14, listing), "status": status})
    cycle(spark, landing, layers, "one")
    bronze = layers.read_bronze(spark).first()
    assert json.loads(bronze["raw_json"]) == listing
    assert json.loads(layers.read_audit(spark).first()["raw_status"]) == status
    more = T.StructType.fromDDL("slug STRING, num_market_pairs INT")
    wider = T.StructType([*COIN.fields, *more.fields])
    cycle(spark, landing, layers, "two", coin=wider)
    rows = {r["batch_id"]: r for r in layers.read_bronze(spark, more).collect()}
    assert rows["two"]["slug"] == "bitcoin" and rows["two"]["num_market_pairs"] == 7
    assert rows["one"]["slug"] is None


@pytest.mark.parametrize("form", ["lines", "payloads", "files", "csv"])
def test_the_first_arrival_stays_whatever_its_price(spark, landing, layers, tmp_path, form):
    first, second = payload(14, coin("BTC", 200.0)), payload(14, coin("BTC", 100.0))
    if form == "lines":
        put(landing, "a.json", json.dumps(first) + "\n" + json.dumps(second) + "\n")
    elif form == "payloads":
        put(landing, "a.json", payload(14, coin("BTC", 200.0), coin("BTC", 100.0)))
    elif form == "files":
        put(landing, "z.json", first)
        put(landing, "a.json", second)
        for name, at in (("z.json", 1_700_000_000), ("a.json", 1_700_000_100)):
            os.utime(landing / name, (at, at))
    else:
        head = "symbol,cmc_rank,quote_USD_price,quote_USD_market_cap,quote_USD_volume_24h,collected_at"
        line = "BTC,1,{},9.0,5.0,2026-05-22T14:17:13+00:00"
        path = tmp_path / "old.csv"
        path.write_text("\n".join([head, line.format(200.0), line.format(100.0), ""]))
        jobs.import_bronze(spark, [str(path)], layers, "old")
        jobs.write_silver(layers.read_bronze(spark), layers, "old")
    if form != "csv":
        cycle(spark, landing, layers, "one", multi_line=form != "lines")
    assert [r["quote_USD_price"] for r in layers.read_silver(spark).collect()] == [200.0]


def test_a_value_of_the_wrong_type_costs_that_value_only(spark, landing):
    put(landing, "a.json", payload(14, coin("BTC", "n/a"), coin("ETH", 2.0, 2)))
    payloads = read_payloads(spark, str(landing))
    got = {r["symbol"]: r for r in to_bronze(payloads).collect()}
    assert got["BTC"]["quote_USD_price"] is None and got["BTC"]["quote_USD_market_cap"] == 1000.0
    assert got["ETH"]["quote_USD_price"] == 2.0
    audit = to_audit(payloads, END).first()
    assert audit["malformed"] and audit["coins_returned"] == 2


def test_audit_has_a_row_for_every_payload(spark, landing):
    put(landing, "a.json", payload(14, coin("BTC", 1.0)))
    put(landing, "b.json", {"status": {"credit_count": 0}, "data": None})
    put(landing, "c.json", '{"status": {"credit_count": 1')
    audit = to_audit(read_payloads(spark, str(landing)), END)
    assert audit.schema.names == AUDIT.names
    got = {r["source_file"][-6:]: r for r in audit.collect()}
    assert got["a.json"]["coins_returned"] == 1 and got["a.json"]["total_count"] == 9000
    assert got["b.json"]["coins_returned"] == 0 and not got["b.json"]["malformed"]
    assert got["c.json"]["malformed"] and got["c.json"]["coins_returned"] == 0
    assert got["b.json"]["collected_at"] is not None  # the time its file arrived
    assert all(r["endpoint"] == END for r in got.values())


def test_one_payload_per_line_reads_the_same(spark, landing, tmp_path):
    one, two = payload(14, coin("BTC", 1.0)), payload(18, coin("BTC", 2.0))
    put(landing, "a.json", one)
    put(landing, "b.json", two)
    lines = tmp_path / "lines"
    put(lines, "all.json", json.dumps(one) + "\n" + json.dumps(two) + "\n")
    hidden = [*ORIGIN.names, "raw_json"]
    several = to_bronze(read_payloads(spark, str(landing))).drop(*hidden)
    single = to_bronze(read_payloads(spark, str(lines), multi_line=False)).drop(*hidden)
    assert sorted(several.collect()) == sorted(single.collect())


def test_silver_values(spark, landing):
    put(landing, "a.json", payload(
        14, coin("BTC", 100.0), coin("ETH", 2.0, rank=2), coin("USDT", 1.0, 3, {"id": 5})
    ))
    silver = to_silver(to_bronze(read_payloads(spark, str(landing))))
    assert silver.schema.names == SILVER.names
    assert [f.dataType for f in silver.schema] == [f.dataType for f in SILVER]
    got = {r["symbol"]: r for r in silver.collect()}
    btc = got["BTC"]
    assert btc["log_return_1h"] == pytest.approx(math.log(1.1))
    assert btc["log_return_24h"] is None and btc["log_return_7d"] is None
    assert btc["volume_to_mcap"] == 0.05 and btc["supply_utilization"] == 0.5
    assert got["ETH"]["supply_utilization"] is None
    assert [got[s]["is_stablecoin"] for s in ("BTC", "USDT")] == [False, True]
    assert [got[s]["is_token"] for s in ("BTC", "USDT")] == [False, True]
    assert btc["last_updated"] is None and btc["date_added"] is not None


def test_the_first_listing_of_a_payload_wins(spark, landing):
    put(landing, "a.json", payload(14, coin("BTC", 9.0), coin("BTC", 3.0), coin("BTC", 5.0)))
    silver = to_silver(to_bronze(read_payloads(spark, str(landing))))
    assert [r["quote_USD_price"] for r in silver.collect()] == [9.0]


def test_nan_is_cleaned_so_that_averages_survive(spark, landing):
    put(landing, "a.json", json.dumps(payload(14, coin("BTC", float("nan")))))
    bronze = to_bronze(read_payloads(spark, str(landing)))
    assert clean(bronze).first()["quote_USD_price"] is None


def cycle(spark, landing, layers, batch, **more):
    return {r["layer"]: r for r in jobs.run_cycle(
        spark, str(landing), layers, batch, END, **more).collect()}


def test_a_cycle_fills_every_layer_and_can_be_repeated(spark, landing, layers):
    put(landing, "a.json", payload(14, coin("BTC", 100.0), coin("USDT", 1.0)))
    put(landing, "b.json", payload(18, coin("BTC", 110.0), coin("USDT", 1.0)))
    first = cycle(spark, landing, layers, "one")
    assert [(first[x]["new_rows"], first[x]["total_rows"]) for x in ("bronze", "silver", "gold")] \
        == [(4, 4), (4, 4), (4, 4)]
    assert first["bronze"]["snapshots"] == 2
    again = cycle(spark, landing, layers, "one")
    assert [again[x]["total_rows"] for x in ("bronze", "silver", "gold")] == [4, 4, 4]
    replay = cycle(spark, landing, layers, "two")
    assert replay["bronze"]["total_rows"] == 8
    assert replay["silver"]["new_rows"] == 0 and replay["silver"]["total_rows"] == 4

    gold = layers.read_gold(spark)
    assert set(gold.columns) == set(GOLD.names)
    movers = reports.latest_movers(gold, date="snapshot_date").collect()
    assert [(r["symbol"], round(r["price_delta_pct"], 6), r["minutes_since_last"])
            for r in movers] == [("BTC", 10.0, 240.0), ("USDT", 0.0, 240.0)]
    volatile = reports.latest_volatility(gold).collect()
    assert [r["symbol"] for r in volatile] == ["BTC"]
    added = reports.new_columns(gold, layers.read_silver(spark))
    assert [r["column"] for r in added.collect()] == sorted(GOLD_FEATURES)


def test_fail_mode_commits_nothing(spark, landing, layers):
    put(landing, "a.json", payload(14, coin("BTC", 100.0), coin("ETH", -1.0)))
    with pytest.raises(QualityError, match="price_positive: 1 rows"):
        cycle(spark, landing, layers, "one", mode="fail")
    assert not Path(layers.silver, "batch_id=one").exists()
    assert layers.read_silver(spark).count() == 0
    assert layers.read_bronze(spark).count() == 2


def test_quarantine_sets_failing_rows_apart(spark, landing, layers):
    put(landing, "a.json", payload(14, coin("BTC", 100.0), coin("ETH", -1.0, 11)))
    got = cycle(spark, landing, layers, "one", mode="quarantine", max_rank=10)
    assert got["silver"]["total_rows"] == 1
    counts = layers.read_notes(spark, "counts").first()
    assert (counts["rows_before"], counts["set_apart"], counts["removed"],
            counts["rows_after"]) == (2, 1, 0, 1)
    failing = {r["check"]: r["failing_rows"] for r in layers.read_notes(spark, "checks").collect()}
    assert {c for c, n in failing.items() if n} == {"price_positive", "rank_in_range"}
    assert len(failing) == 6
    nulls = {r["column"]: r["nulls"] for r in layers.read_notes(spark, "nulls").collect()}
    assert nulls["platform_id"] == 1 and "symbol" not in nulls
    apart = spark.read.parquet(layers.quarantine).collect()
    assert [(r["symbol"], r["failed_checks"]) for r in apart] == [
        ("ETH", ["price_positive", "rank_in_range"])
    ]


def test_ranks_have_no_bound_unless_given(spark, landing, layers):
    put(landing, "a.json", payload(14, *[coin(f"C{i}", 1.0, i) for i in range(1, 26)]))
    assert cycle(spark, landing, layers, "one")["silver"]["total_rows"] == 25


def test_an_empty_payload_goes_through(spark, landing, layers):
    put(landing, "a.json", payload(14))
    for mode in jobs.MODES:
        got = cycle(spark, landing, layers, mode, mode=mode)
        assert [got[x]["total_rows"] for x in ("bronze", "silver", "gold")] == [0, 0, 0]


def test_a_failed_rebuild_leaves_the_old_gold(spark, landing, layers):
    put(landing, "a.json", payload(14, coin("BTC", 100.0)))
    cycle(spark, landing, layers, "one")
    before = layers.read_gold(spark).collect()
    broken = layers.read_gold(spark).withColumn(
        "price_sma_3", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        tables.replace_layer(broken, layers.gold)
    assert layers.read_gold(spark).collect() == before
    for _ in range(3):
        jobs.rebuild_gold(spark, layers)
    versions = [p.name for p in Path(layers.gold).iterdir() if p.name.startswith("v-")]
    assert len(versions) == 2 and layers.read_gold(spark).collect() == before


def folders(layers):
    return sorted(p.name for p in Path(layers.silver).glob("batch_id=*"))


def test_compaction_keeps_every_row_and_its_batch(spark, landing, layers):
    for hour, name in ((4, "one"), (8, "two"), (12, "three")):
        put(landing, f"{name}.json", payload(hour, coin("BTC", 100.0 + hour), coin("ETH", 9.0)))
        jobs.write_bronze(
            read_payloads(spark, str(landing / f"{name}.json")), layers, name, END)
        bronze = tables.read_some(spark, layers.bronze, BRONZE, [name])
        jobs.write_silver(bronze, layers, name)
        if name != "one":
            before = sorted(layers.read_batches(spark, "silver", SILVER).collect(), key=str)
            jobs.compact_silver(spark, layers)
            after = layers.read_batches(spark, "silver", SILVER)
            assert sorted(after.select(*before[0].__fields__).collect(), key=str) == before
    # The folders merged first are gone, those merged last stay for readers that have begun.
    assert folders(layers) == ["batch_id=three"]
    assert layers.read_silver(spark).count() == 6
    some = layers.read_batches(spark, "silver", SILVER, ["one", "three", "none"])
    assert {r["batch_id"]: r["count"] for r in some.groupBy("batch_id").count().collect()} \
        == {"one": 2, "three": 2}
    jobs.compact_silver(spark, layers)
    assert folders(layers) == [] and layers.read_silver(spark).count() == 6

    all_bronze = layers.read_bronze(spark)
    jobs.write_silver(all_bronze, layers, "replay")
    assert layers.read_silver(spark).count() == 6
    with pytest.raises(ValueError, match="compacted"):
        jobs.write_silver(all_bronze, layers, "two")


def test_a_failed_compaction_leaves_silver_as_it_was(spark, landing, layers, monkeypatch):
    put(landing, "a.json", payload(14, coin("BTC", 100.0), coin("USDT", 1.0)))
    cycle(spark, landing, layers, "one")

    def lost(spark, path, text):
        raise OSError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(files, "write_newest", lost)
        with pytest.raises(OSError, match="driver lost"):
            jobs.compact_silver(spark, layers)
    assert layers.read_silver(spark).count() == 2
    jobs.compact_silver(spark, layers)
    jobs.compact_silver(spark, layers)
    assert folders(layers) == [] and layers.read_silver(spark).count() == 2


class Lost(Exception):
    pass


def losing(monkeypatch, after):
    """The driver is lost instead of its ``after``-th change to the files."""
    left = [after]

    def guard(do):
        def run(*args, **settings):
            left[0] -= 1
            if left[0] < 0:
                raise Lost
            return do(*args, **settings)
        return run

    for name in ("rename", "delete"):
        monkeypatch.setattr(files, name, guard(getattr(files, name)))
    return left


def prices(layers, spark, layer):
    found = layers.read(spark, layer).select("symbol", "collected_at", "quote_USD_price")
    return sorted(found.collect(), key=str)


def test_no_loss_of_the_driver_loses_a_row(spark, landing, layers, monkeypatch):
    """Lost between any two file operations of a rebuild, a compaction or a batch written again:
    readers see all rows, and running the job again completes it."""
    for hour, name in ((4, "one"), (8, "two"), (12, "three")):
        put(landing, f"{name}.json", payload(hour, coin("BTC", 100.0 + hour), coin("ETH", 9.0)))
        jobs.write_bronze(read_payloads(spark, str(landing / f"{name}.json")), layers, name, END)
        bronze = layers.read_batches(spark, "bronze", BRONZE, [name])
        jobs.write_silver(bronze, layers, name)
        if name == "two":
            jobs.compact(spark, layers)
    jobs.rebuild_gold(spark, layers)
    silver, gold = prices(layers, spark, "silver"), prices(layers, spark, "gold")
    assert len(silver) == len(gold) == 6
    for job in (
        lambda: jobs.rebuild_gold(spark, layers),
        lambda: jobs.write_silver(bronze, layers, "three"),
        lambda: jobs.compact(spark, layers),
    ):
        for after in range(40):
            with monkeypatch.context() as patch:
                left = losing(patch, after)
                try:
                    job()
                except Lost:
                    pass
            assert prices(layers, spark, "silver") == silver
            assert prices(layers, spark, "gold") == gold
            if left[0] >= 0:
                break
        else:
            raise AssertionError("the job never got through")
    jobs.rebuild_gold(spark, layers)
    assert prices(layers, spark, "silver") == silver and prices(layers, spark, "gold") == gold


def test_compaction_writes_a_row_again_a_few_times_only(spark, layers):
    schema = BRONZE
    for n in range(12):
        rows = spark.createDataFrame([(f"K{n}",)], "symbol STRING").transform(
            lambda df: tables.conform(df, schema))
        tables.write_batch(rows, layers.bronze, f"stream-{n:012d}")
        tables.commit(spark, layers.commits("bronze"), f"stream-{n:012d}")
        jobs.compact(spark, layers, "bronze")
    found, held = tables.runs(spark, layers.base("bronze"))
    assert held.upto == 11 and not held.names
    assert sum(r.rows for r in found) == 12 and len(found) <= 4
    assert [r["symbol"] for r in layers.read_bronze(spark).orderBy("symbol").collect()] \
        == sorted(f"K{n}" for n in range(12))
    assert "stream-000000000003" in held and "stream-000000000012" not in held
    assert "other" in held.plus(["other"]) and held.plus(["other"]).upto == 11


def test_further_fields_reach_gold(spark, landing, layers):
    first = {**coin("BTC", 100.0), "slug": "bitcoin", "tag": {"id": 7}}
    put(landing, "a.json", payload(14, first, coin("ETH", 1.0)))
    wide = T.StructType([*COIN.fields, *T.StructType.fromDDL(
        "slug STRING, tag STRUCT<id: BIGINT>").fields])
    more = further_fields(wide)
    assert more.names == ["slug", "tag_id"]
    jobs.run_cycle(spark, str(landing), layers, "one", END, coin=wide)
    for df in (layers.read_silver(spark, more), layers.read_gold(spark, more)):
        got = {r["symbol"]: (r["slug"], r["tag_id"]) for r in df.collect()}
        assert got == {"BTC": ("bitcoin", 7), "ETH": (None, None)}


def test_the_text_of_a_malformed_payload_is_kept(spark, landing, layers):
    put(landing, "a.json", payload(14, coin("BTC", 1.0)))
    put(landing, "b.json", '{"data": [{"symbol": "E')
    cycle(spark, landing, layers, "one")
    kept = {r["malformed"]: r["raw_payload"] for r in layers.read_audit(spark).collect()}
    assert kept == {False: None, True: '{"data": [{"symbol": "E'}


def test_the_overview_is_merged_from_the_batches_summaries(spark, landing, layers):
    assert jobs.overview(spark, layers).first()["rows"] == 0
    for hour in (3, 7):
        put(landing, f"{hour}.json", payload(hour, coin("BTC", 1.0), coin(f"C{hour}", 1.0)))
        cycle(spark, landing, layers, f"b{hour}")
    got = jobs.overview(spark, layers)
    want = reports.data_overview(layers.read_silver(spark)).first()
    assert all(got.first()[c] == want[c] for c in want.__fields__)
    assert got.first()["rows"] == 4
    assert got.inputFiles() and all("/silver_summary/" in f for f in got.inputFiles())


def test_live_gold_can_be_compacted(spark, landing, layers):
    from tidemark.streaming import jobs as streams
    for hour in (2, 4, 3, 9):
        put(landing, f"{hour}.json", payload(hour, coin("BTC", 10.0 + hour)))
        streams.bronze_stream(spark, str(landing), layers, END).awaitTermination()
        streams.silver_stream(spark, layers).awaitTermination()
        streams.gold_stream(spark, layers).awaitTermination()
        jobs.compact(spark, layers, "live_gold")
    jobs.rebuild_gold(spark, layers)
    live = streams.read_live_gold(spark, layers).select(*GOLD.names).collect()
    assert sorted(live, key=str) == sorted(
        layers.read_gold(spark).select(*GOLD.names).collect(), key=str)
    assert str(streams.latest_date(spark, layers)) == "2026-05-22"


def test_batch_ids_are_names(spark, landing, layers):
    put(landing, "a.json", payload(14, coin("BTC", 100.0)))
    for bad in ("a/b", "a=b", "a:b", "", "..", "a b", "50%"):
        with pytest.raises(ValueError, match="letters, digits"):
            cycle(spark, landing, layers, bad)


def test_report_mode_lets_rows_pass(spark, landing, layers):
    put(landing, "a.json", payload(14, coin("BTC", 100.0), coin("ETH", -1.0)))
    got = cycle(spark, landing, layers, "one", mode="report")
    assert got["silver"]["total_rows"] == 2
    with pytest.raises(ValueError):
        cycle(spark, landing, layers, "one", mode="other")


def test_rows_without_a_time_are_not_added_twice(spark, landing, layers):
    put(landing, "a.json", {**payload(14, coin("BTC", 1.0)), "collected_at": "junk"})
    for batch in ("one", "two"):
        cycle(spark, landing, layers, batch, mode="report")
    assert layers.read_silver(spark).count() == 1


def test_only_dates_of_the_batch_are_read_from_silver(spark, landing, layers):
    put(landing, "a.json", payload(14, coin("BTC", 1.0)))
    put(landing, "b.json", payload(14, coin("BTC", 2.0), day=23))
    cycle(spark, landing, layers, "one")
    new = clean(to_bronze(read_payloads(spark, str(landing / "b.json"))))
    kept = jobs._same_times(layers.read_silver(spark), jobs._counted(new, snapshot_checks()))
    times = kept.select(F.col("collected_at").cast("timestamp_ntz")).collect()
    assert [r[0] for r in times] == [datetime(2026, 5, 23, 14, 17, 13)]
    scan = next(x for x in kept._jdf.queryExecution().executedPlan().toString().splitlines()
                if "FileScan" in x)
    filters = scan.split("PartitionFilters")[1]
    assert "snapshot_date" in filters.split("PushedFilters")[0]
    assert "GreaterThanOrEqual(collected_at" in filters.split("PushedFilters")[1]


def test_gold_with_a_cut_symbol_equals_uncut_gold(spark, landing, layers):
    for hour in range(24):
        put(landing, f"{hour:02d}.json", payload(hour, coin("BTC", 100.0 + hour), coin("ETH", 2.0)))
    cycle(spark, landing, layers, "one")
    whole = layers.read_gold(spark).collect()
    jobs.rebuild_gold(spark, layers, rows_per_part=5)
    assert layers.read_gold(spark).count() == 48
    assert sorted(whole, key=str) == sorted(layers.read_gold(spark).collect(), key=str)


def test_gold_files_are_sorted_by_key_within_a_date(spark, landing, layers):
    for hour in (5, 3):
        put(landing, f"{hour}.json", payload(hour, coin("ETH", 2.0), coin("BTC", 1.0 + hour)))
    put(landing, "next.json", payload(1, coin("BTC", 9.0), day=23))
    cycle(spark, landing, layers, "one")
    version = tables.current_version(spark, layers.gold)
    assert str(tables.last_date(spark, version)) == "2026-05-23"
    for folder in Path(version).glob("snapshot_date=*"):
        for part in folder.glob("*.parquet"):
            keys = pq.read_table(part, columns=["symbol", "collected_at"]).to_pylist()
            assert keys == sorted(keys, key=lambda r: (r["symbol"], r["collected_at"]))
    history = reports.key_history(layers.read_gold(spark), "BTC", ["quote_USD_price"])
    assert [r[0] for r in history.collect()] == [4.0, 6.0, 9.0]


def test_history_kept_as_csv_can_be_imported_and_exported(spark, layers, tmp_path):
    head = ("symbol,name,cmc_rank,platform_id,quote_USD_price,quote_USD_market_cap,"
            "quote_USD_volume_24h,collected_at\n")
    one, two = tmp_path / "one.csv", tmp_path / "two.csv"
    one.write_text(head + "BTC,Bitcoin,1,,100.5,1000.0,5.0,2026-05-22T14:17:13+00:00\n"
                   "USDT,Tether,3,825.0,1.0,10.0,5.0,2026-05-22T14:17:13+00:00\n")
    columns = head.strip().split(",")
    values = dict(zip(columns, "BTC,Bitcoin,1,,110.55,1000.0,5.0,2026-05-22T18:17:13+00:00"
                      .split(","), strict=True))
    two.write_text(",".join(reversed(columns)) + "\n"
                   + ",".join(values[c] for c in reversed(columns)) + "\n")
    jobs.import_bronze(spark, [str(one), str(two)], layers, "old")
    jobs.write_silver(layers.read_bronze(spark), layers, "old")
    jobs.rebuild_gold(spark, layers)
    gold = sorted(layers.read_gold(spark).collect(), key=lambda r: (r["symbol"], r["collected_at"]))
    assert [(r["symbol"], r["platform_id"], r["is_token"]) for r in gold] == [
        ("BTC", None, False), ("BTC", None, False), ("USDT", 825, True)]
    assert gold[1]["price_delta_pct"] == pytest.approx(10.0)
    tables.export_csv(layers.read(spark, "gold"), str(tmp_path / "out"))
    back = tables.import_csv(spark, [str(tmp_path / "out")], GOLD, lenient=False).collect()
    assert sorted(back, key=str) == sorted(
        layers.read_gold(spark).select(*GOLD.names).collect(), key=str)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_new_silver_rows_take_one_exchange_and_no_join(spark, landing, layers):
    put(landing, "a.json", payload(14, coin("BTC", 1.0)))
    cycle(spark, landing, layers, "one")
    cleaned = clean(layers.read_bronze(spark))
    plan = plan_of(silver_increment(cleaned, layers.read_silver(spark)))
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert "Partial" in plan.split("Exchange")[1]
    stored = plan.split("FileScan")[2].split("ReadSchema: ")[1]
    assert stored.startswith("struct<symbol:string,collected_at:timestamp>")


def test_latest_reports_prune_to_the_last_date(spark, landing, layers):
    put(landing, "a.json", payload(14, coin("BTC", 1.0)))
    cycle(spark, landing, layers, "one")
    plan = plan_of(reports.latest_dominance(layers.read_gold(spark), date="snapshot_date"))
    scan = next(x for x in plan.splitlines() if "FileScan" in x and "dominance" in x)
    assert "Subquery" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "quote_USD_price" not in scan.split("ReadSchema")[1]


def test_many_malformed_payloads_of_one_date_are_not_one_task(spark, landing, layers):
    """One file, and so one task, has them all; as audit rows they are some 30 times larger."""
    lines = spark.range(0, 300_000, 1, 1).selectExpr("concat('{\"status\": ', sha2(string(id), 256)) AS value")
    lines.write.mode("append").text(str(landing))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    jobs.write_bronze(read_payloads(spark, str(landing), multi_line=False), layers, "b1", "origin")
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == before
    audit = layers.read_audit(spark)
    written = audit.groupBy(F.input_file_name()).count().select("count").collect()
    assert sum(r["count"] for r in written) == 300_000 and audit.filter("malformed").count() == 300_000
    assert max(r["count"] for r in written) <= 200_000
