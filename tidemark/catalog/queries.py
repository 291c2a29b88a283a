"""The registered queries. Each takes (spark, folder of tables) and returns a DataFrame
that reads whole tables; the SQL of the same name in ``oracles`` gives the same rows.

Values both engines compute with the same float operations are left as they are;
logarithms, deviations and averages are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.derived import (
    DAILY, ENDPOINT, EVENTS, daily, day_thirds, land, land_copies, stored_daily, table,
)
from tidemark.catalog.registry import REGISTRY, query
from tidemark.catalog.registry import r6 as _r6
from tidemark.functions import scalar, series
from tidemark.operators import dedup, nested, quality, reports
from tidemark.operators.history import find_cut_points, over_history
from tidemark.plans import jobs
from tidemark.plans.jobs import Layers
from tidemark.plans.layers import rebased, to_gold
from tidemark.session import scratch_path
from tidemark.sources import files, tables
from tidemark.sources.landing import read_payloads
from tidemark.sources.schemas import COIN, GOLD_FEATURES, ORIGIN
from tidemark.streaming import jobs as streams

def _text(c: str) -> Column:
    return F.col(c).cast("string")


# --- features along a key's history -----------------------------------------------------


def _along(
    spark: SparkSession,
    sf_dir: str,
    name: str,
    feature: Callable[[WindowSpec], Column],
    look_back: int,
    exact: bool = True,
) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    result = over_history(
        events,
        lambda df, w: df.withColumn(name, EVENTS.masked(feature(w))),
        EVENTS,
        look_back,
        ["value"],
        find_cut_points(events, EVENTS),
    )
    return result.select("event_id", "user_id", F.col(name) if exact else _r6(name).alias(name))


@query
def price_delta(spark, sf_dir):
    return _along(
        spark, sf_dir, "price_delta_pct", lambda w: series.pct_change(F.col("value"), w), 1
    )


@query
def minutes_since_last(spark, sf_dir):
    return _along(
        spark, sf_dir, "minutes_since_last", lambda w: series.minutes_since_last(F.col("ts"), w), 1
    )


@query
def observed_log_return(spark, sf_dir):
    return _along(
        spark, sf_dir, "observed_log_return",
        lambda w: series.observed_log_return(F.col("value"), w), 1, exact=False,
    )


@query
def sma_3(spark, sf_dir):
    return _along(
        spark, sf_dir, "price_sma_3", lambda w: series.rolling(F.col("value"), 3, w), 2, exact=False
    )


@query
def sma_7(spark, sf_dir):
    return _along(
        spark, sf_dir, "price_sma_7", lambda w: series.rolling(F.col("value"), 7, w), 6, exact=False
    )


@query
def rolling_surface(spark, sf_dir):
    """Any aggregate over any number of rows, with a minimum number of values."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        value = F.col("value")
        return df.withColumns({
            "max_5": series.rolling(value, 5, w, F.max, min_periods=3),
            "min_5": series.rolling(value, 5, w, F.min, min_periods=3),
            "sum_4": series.rolling(value, 4, w, F.sum, min_periods=2),
        })

    cuts = find_cut_points(events, EVENTS)
    return over_history(events, compute, EVENTS, 4, ["value"], cuts).select(
        "event_id", "user_id", "max_5", "min_5", _r6("sum_4").alias("sum_4")
    )


def _featured(events: DataFrame, rows_per_part: int | None = None) -> DataFrame:
    columns = events.select("event_id", "user_id", "ts", "value")
    cuts = (
        find_cut_points(columns, EVENTS)
        if rows_per_part is None
        else find_cut_points(columns, EVENTS, rows_per_part)
    )
    gold = to_gold(columns, EVENTS, "value", "value", cuts)
    return gold.select(
        "event_id", "user_id", "value",
        "price_delta_pct", "minutes_since_last",
        _r6("observed_log_return").alias("observed_log_return"),
        _r6("price_sma_3").alias("price_sma_3"),
        _r6("price_sma_7").alias("price_sma_7"),
        _r6("volatility_3").alias("volatility_3"),
        "dominance_delta",
    )


@query
def volatility_3(spark, sf_dir):
    return _featured(table(spark, sf_dir, "events")).select("event_id", "user_id", "volatility_3")


@query
def gold_features(spark, sf_dir):
    """All features of every event's history from one shuffle."""
    return _featured(table(spark, sf_dir, "events"))


@query
def hot_key_features(spark, sf_dir):
    """The same with a third of the users merged into one key, which is then cut up."""
    events = table(spark, sf_dir, "events")
    user = F.col("user_id")
    merged = events.withColumn("user_id", F.when(user % 3 == 0, F.lit(0)).otherwise(user))
    return _featured(merged, rows_per_part=500)


@query
def rebased_series(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("flagged", F.col("event_type") == "error")
    columns = events.select("event_id", "user_id", "ts", "value", "flagged")
    cuts = find_cut_points(columns, EVENTS)
    return rebased(columns, EVENTS, "value", "flagged", cuts=cuts).select(
        "event_id", "user_id", "rebased"
    )


@query
def hot_key_rebased(spark, sf_dir):
    """Rebased series with a third of the users as one key, which is then cut up."""
    user = F.col("user_id")
    events = table(spark, sf_dir, "events").select(
        "event_id", "ts", "value",
        F.when(user % 3 == 0, F.lit(0)).otherwise(user).alias("user_id"),
    )
    cuts = find_cut_points(events, EVENTS, rows_per_part=500)
    return rebased(events, EVENTS, "value", None, cuts=cuts).select(
        "event_id", "user_id", "rebased"
    )


@query
def first_difference(spark, sf_dir):
    # A user has at most one row per calendar day here, so no history needs cutting.
    share = daily(spark, sf_dir).withColumn("share", scalar.ratio("low", "high") * 100)
    w = DAILY.window()
    return share.select(
        "user_id", _text("day").alias("day"),
        DAILY.masked(series.difference(F.col("share"), w)).alias("dominance_delta"),
    )


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last day is read from, without computing anything for it."""
    return table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"))


def _daily_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = daily(spark, sf_dir).withColumn("flagged", F.col("user_id").isin(1, 2, 3))
    return to_gold(snapshots, DAILY, "value", "low")


@query
def latest_movers(spark, sf_dir):
    return reports.latest_movers(
        _daily_gold(spark, sf_dir), "user_id", "day", "value", times=_days(spark, sf_dir)
    )


@query
def latest_volatility(spark, sf_dir):
    report = reports.latest_volatility(
        _daily_gold(spark, sf_dir), "user_id", "day", "value", "flagged",
        times=_days(spark, sf_dir),
    )
    return report.withColumn("volatility_3", _r6("volatility_3"))


@query
def latest_dominance(spark, sf_dir):
    return reports.latest_dominance(
        _daily_gold(spark, sf_dir), "user_id", "day", "low", times=_days(spark, sf_dir)
    )


@query
def key_history(spark, sf_dir):
    """Price against its averages for the user with the most events."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    busiest = (
        events.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").limit(1)
        .select("user_id").scalar()
    )
    rows = events.filter(F.col("user_id") == busiest)
    gold = to_gold(rows, EVENTS, "value", None, find_cut_points(rows, EVENTS))
    return gold.select(
        "event_id", "value", _r6("price_sma_3").alias("price_sma_3"),
        _r6("price_sma_7").alias("price_sma_7"), "ts",
    ).orderBy("ts", "event_id")


# --- row-level expressions --------------------------------------------------------------


@query
def member_flag(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") != "error", F.col("event_type"))
    return events.select(
        "event_id", scalar.member_flag(kind, {"view", "click", "error"}).alias("is_member")
    )


@query
def not_null_flag(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", scalar.present_flag(F.nullif("event_type", F.lit("error"))).alias("is_token")
    )


@query
def pct_log_returns(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    changes = {
        "log_return_1h": F.col("l_discount") * 100,
        "log_return_24h": F.col("l_tax") * -100,
        "log_return_7d": (F.col("l_tax") - F.col("l_discount")) * 2000,
    }
    return lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *[_r6(scalar.log_return(pct)).alias(name) for name, pct in changes.items()],
    )


@query
def safe_ratios(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        scalar.ratio("l_extendedprice", "l_quantity").alias("volume_to_mcap"),
        scalar.ratio("l_tax", "l_discount").alias("supply_utilization"),
    )


@query
def parse_timestamps(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    text = F.col("ts").cast("string")
    mixed = F.when(F.col("event_type") == "error", F.lit("junk")).otherwise(
        F.concat(text, F.lit("+02:00"))
    )
    return events.select(
        "event_id",
        scalar.parse_time(mixed).cast("timestamp_ntz").alias("lenient"),
        scalar.parse_time(text, strict=True).cast("timestamp_ntz").alias("strict"),
    )


# --- duplicates and checks --------------------------------------------------------------

_LINE_KEY = ["l_partkey", "l_shipdate"]


@query
def dedup_first(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    order = [c for c in lineitem.columns if c not in _LINE_KEY]
    return dedup.keep_first(lineitem, _LINE_KEY, order).select(
        "l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"
    )


@query
def dedup_counts(spark, sf_dir):
    return dedup.dedup_counts(table(spark, sf_dir, "lineitem"), _LINE_KEY)


@query
def duplicate_keys(spark, sf_dir):
    return dedup.duplicate_keys(table(spark, sf_dir, "lineitem"), _LINE_KEY)


@query
def null_profile(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id",
        F.nullif("event_type", F.lit("error")).alias("platform_id"),
        F.when(F.col("value") > 50, F.col("value")).alias("max_supply"),
        F.when(F.col("value") > 100, F.lit(float("nan"))).otherwise(F.col("value")).alias("tvl"),
        "ts",
    )
    profile = quality.null_profile(events)
    return profile.withColumn("pct", _r6("pct"))


def _event_checks() -> list[quality.Check]:
    return [
        quality.Check("value_positive", scalar.positive("value")),
        quality.Check("value_above_one", scalar.positive(F.col("value") - 1)),
        quality.Check("value_non_negative", scalar.non_negative("value")),
        quality.Check("rank_in_range", scalar.in_range(F.col("user_id") % 12, 1, 10)),
        quality.Check("ts_present", F.col("ts").isNotNull()),
    ]


@query
def quality_checks(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return quality.check_report(events, _event_checks(), unique=["user_id", "ts"])


@query
def duplicate_check(spark, sf_dir):
    """Key uniqueness where it does not hold: rows beyond the first of their key."""
    return quality.check_report(table(spark, sf_dir, "lineitem"), [], unique=_LINE_KEY)


@query
def quarantined_rows(spark, sf_dir):
    _, failing = quality.split_rows(table(spark, sf_dir, "events"), _event_checks())
    return failing.select("event_id", F.array_join("failed_checks", ",").alias("failed_checks"))


@query
def enforced_rows(spark, sf_dir):
    """Rows behind checks that hold; a failing one would stop the query."""
    checks = [c for c in _event_checks() if c.name in ("value_non_negative", "ts_present")]
    return quality.enforce(table(spark, sf_dir, "events"), checks).select("event_id", "value")


# --- reports ----------------------------------------------------------------------------


@query
def data_overview(spark, sf_dir):
    return reports.data_overview(table(spark, sf_dir, "events"), "user_id", "ts")


@query
def snapshot_times(spark, sf_dir):
    return reports.snapshot_times(table(spark, sf_dir, "orders"), "o_orderdate")


@query
def top_n_per_snapshot(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    order = [F.col("o_totalprice").desc_nulls_last(), F.col("o_orderkey").asc()]
    top = reports.top_per_snapshot(orders, "o_orderdate", order, start=1, limit=3)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query
def ranks_beyond_limit(spark, sf_dir):
    """A deep slice: ranks 1001 to 3000 of each return flag by price."""
    ties = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", *ties)
    top = reports.deep_slice(lines, "l_returnflag", "l_extendedprice", ties, start=1001, limit=2000)
    return top.withColumn("rank", F.col("rank").cast("bigint"))


@query
def first_row(spark, sf_dir):
    """The one-row sample: the earliest event."""
    events = table(spark, sf_dir, "events")
    earliest = events.orderBy("ts", "event_id").limit(1)
    return earliest.select("event_id", "user_id", "event_type", "value", "ts")


@query
def table_profile(spark, sf_dir):
    profile = reports.table_profile(table(spark, sf_dir, "events"))
    return profile.select("position", "column", "dtype", "row_count", "column_count")


@query
def new_columns(spark, sf_dir):
    """Columns Gold adds, with how many of its rows have a value there."""
    snapshots = daily(spark, sf_dir)
    return reports.new_columns(to_gold(snapshots, DAILY, "value", "low"), snapshots, counts=True)


# --- nested data ------------------------------------------------------------------------


@query
def json_flatten(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "event_id", F.from_json("props", "k BIGINT").alias("props")
    )
    return nested.flatten_structs(events)


@query
def json_explode(spark, sf_dir):
    """Every line of every document as its own row, with its place in the text."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.transform(
            F.split("text", "\n"), lambda line: F.struct(line.alias("line"))
        ).alias("lines"),
        nested.array_length(F.split("text", "\n")).cast("bigint").alias("n_lines"),
    )
    rows = nested.explode_records(documents, "lines", position="place")
    return rows.select("doc_id", "n_lines", F.col("place").cast("bigint").alias("place"), "line")


# --- layers on disk ---------------------------------------------------------------------


def _landed(spark: SparkSession, sf_dir: str) -> tuple[str, Layers]:
    landing = scratch_path(spark, "landing")
    land(daily(spark, sf_dir), landing)
    return landing, Layers(scratch_path(spark, "layers"))


def _bronze_view(bronze: DataFrame) -> DataFrame:
    hidden = (*ORIGIN.names, "raw_json", "batch_id", "snapshot_date")
    kept = [c for c in bronze.columns if c not in hidden]
    return bronze.select(*kept, _text("snapshot_date").alias("snapshot_date"))


def _silver_view(silver: DataFrame) -> DataFrame:
    moments = ("date_added", "last_updated", "quote_USD_last_updated", "collected_at")
    shown = []
    for name in silver.columns:
        if name in moments:
            shown.append(F.col(name).cast("timestamp_ntz").alias(name))
        elif name.startswith("log_return"):
            shown.append(_r6(name).alias(name))
        elif name == "snapshot_date":
            shown.append(_text(name).alias(name))
        else:
            shown.append(F.col(name))
    return silver.select(*shown)


def _gold_view(gold: DataFrame) -> DataFrame:
    rounded = ("observed_log_return", "price_sma_3", "price_sma_7", "volatility_3")
    features = [_r6(c).alias(c) if c in rounded else F.col(c) for c in GOLD_FEATURES]
    moment = F.col("collected_at").cast("timestamp_ntz").alias("collected_at")
    return gold.select("symbol", moment, "quote_USD_price", *features)


@query
def bronze_layer(spark, sf_dir):
    """Landing JSON to flat Bronze rows, written and read back."""
    landing, layers = _landed(spark, sf_dir)
    jobs.write_bronze(read_payloads(spark, landing, multi_line=False), layers, "b1", ENDPOINT)
    return _bronze_view(layers.read_bronze(spark))


@query
def audit_layer(spark, sf_dir):
    """One row per payload with its status fields and record count."""
    landing, layers = _landed(spark, sf_dir)
    jobs.write_bronze(read_payloads(spark, landing, multi_line=False), layers, "b1", ENDPOINT)
    return layers.read_audit(spark).select(
        "credit_count", "total_count", "elapsed", "collected_at", "endpoint", "coins_returned",
        "malformed",
    )


def _silver_written(spark: SparkSession, sf_dir: str) -> Layers:
    landing, layers = _landed(spark, sf_dir)
    jobs.write_bronze(read_payloads(spark, landing, multi_line=False), layers, "b1", ENDPOINT)
    jobs.write_silver(layers.read_bronze(spark), layers, "b1", "quarantine")
    return layers


@query
def silver_layer(spark, sf_dir):
    return _silver_view(_silver_written(spark, sf_dir).read_silver(spark))


@query
def gold_layer(spark, sf_dir):
    layers = _silver_written(spark, sf_dir)
    jobs.rebuild_gold(spark, layers)
    return _gold_view(layers.read_gold(spark))


@query
def gold_movers(spark, sf_dir):
    """The movers report read from stored Gold, pruned to its last date."""
    layers = _silver_written(spark, sf_dir)
    jobs.rebuild_gold(spark, layers)
    last = tables.last_date(spark, tables.current_version(spark, layers.gold))
    return reports.latest_movers(layers.read_gold(spark), date="snapshot_date", on=last)


@query
def cycle_counts(spark, sf_dir):
    """One whole cycle from landing to Gold, with the row counts of each layer."""
    landing, layers = _landed(spark, sf_dir)
    return jobs.run_cycle(
        spark, landing, layers, "c1", ENDPOINT, mode="quarantine", multi_line=False
    )


@query
def silver_idempotent(spark, sf_dir):
    """Silver from two overlapping batches, the second one run twice."""
    landing, layers = _landed(spark, sf_dir)
    jobs.write_bronze(read_payloads(spark, landing, multi_line=False), layers, "b1", ENDPOINT)
    bronze = layers.read_bronze(spark)
    middle = bronze.select(F.percentile_approx(F.unix_date("snapshot_date"), 0.5)).scalar()
    early = bronze.filter(F.unix_date("snapshot_date") <= middle)
    jobs.write_silver(early, layers, "s1", "quarantine")
    jobs.write_silver(bronze, layers, "s2", "quarantine")
    jobs.write_silver(bronze, layers, "s2", "quarantine")
    return _silver_view(layers.read_silver(spark))


@query
def silver_compacted(spark, sf_dir):
    """Silver of three batches that overlap, merged after the first and after the last."""
    landing, layers = _landed(spark, sf_dir)
    jobs.write_bronze(read_payloads(spark, landing, multi_line=False), layers, "b1", ENDPOINT)
    bronze = layers.read_bronze(spark)
    middle = bronze.select(F.percentile_approx(F.unix_date("snapshot_date"), 0.5)).scalar()
    early = bronze.filter(F.unix_date("snapshot_date") <= middle)
    jobs.write_silver(early, layers, "s1", "quarantine")
    jobs.compact_silver(spark, layers)
    jobs.write_silver(bronze, layers, "s2", "quarantine")
    jobs.write_silver(bronze, layers, "s3", "quarantine")
    jobs.compact_silver(spark, layers)
    return _silver_view(layers.read_silver(spark))


def _fields(df: DataFrame, text: str, kept: list, **fields: str) -> DataFrame:
    """Fields that no schema declares, from the text that the layer keeps."""
    return df.select(
        *kept,
        *[F.get_json_object(text, f"$.{name}").cast(kind).alias(name)
          for name, kind in fields.items()],
    )


_MORE_COIN = {"slug": "string", "num_market_pairs": "bigint"}
_MORE_STATUS = {"error_code": "int", "error_message": "string"}


@query
def bronze_raw(spark, sf_dir):
    """Fields of the listings that no schema declares."""
    landing, layers = _landed(spark, sf_dir)
    jobs.write_bronze(read_payloads(spark, landing, multi_line=False), layers, "b1", ENDPOINT)
    kept = ["symbol", "collected_at"]
    return _fields(layers.read_bronze(spark), "raw_json", kept, **_MORE_COIN)


@query
def bronze_wider(spark, sf_dir):
    """The same as typed columns, by a wider schema."""
    landing, layers = _landed(spark, sf_dir)
    more = T.StructType.fromDDL("slug STRING, num_market_pairs BIGINT")
    jobs.write_bronze(
        read_payloads(spark, landing, multi_line=False), layers, "b1", ENDPOINT,
        coin=T.StructType([*COIN.fields, *more.fields]),
    )
    return layers.read_bronze(spark, more).select("symbol", "collected_at", *more.names)


@query
def audit_errors(spark, sf_dir):
    """Errors of the payloads' status, which no schema declares."""
    landing, layers = _landed(spark, sf_dir)
    jobs.write_bronze(read_payloads(spark, landing, multi_line=False), layers, "b1", ENDPOINT)
    kept = ["collected_at", "elapsed"]
    return _fields(layers.read_audit(spark), "raw_status", kept, **_MORE_STATUS)


def _copies_written(spark: SparkSession, sf_dir: str, apart: bool) -> Layers:
    landing, layers = scratch_path(spark, "landing"), Layers(scratch_path(spark, "layers"))
    land_copies(daily(spark, sf_dir), landing, apart)
    jobs.write_bronze(read_payloads(spark, landing, multi_line=False), layers, "b1", ENDPOINT)
    return layers


@query
def first_arrival_lines(spark, sf_dir):
    """Silver where a lower-priced copy of every payload follows in the same file."""
    layers = _copies_written(spark, sf_dir, apart=False)
    jobs.write_silver(layers.read_bronze(spark), layers, "b1", "quarantine")
    return _silver_view(layers.read_silver(spark))


@query
def first_arrival_files(spark, sf_dir):
    """Silver where a lower-priced copy of every payload comes in a later file."""
    layers = _copies_written(spark, sf_dir, apart=True)
    jobs.write_silver(layers.read_bronze(spark), layers, "b1", "quarantine")
    return _silver_view(layers.read_silver(spark))


@query
def first_arrival_csv(spark, sf_dir):
    """Silver from CSV files in which every listing is followed by a lower-priced copy."""
    bronze = _copies_written(spark, sf_dir, apart=False).read_bronze(spark)
    keys = ["symbol", "collected_at"]
    ordered = bronze.repartition(*keys).sortWithinPartitions(*keys, *ORIGIN.names)
    path, layers = scratch_path(spark, "csv"), Layers(scratch_path(spark, "layers"))
    tables.export_csv(ordered.drop(*ORIGIN.names, "raw_json", "batch_id", "snapshot_date"), path)
    jobs.import_bronze(spark, [path], layers, "old")
    jobs.write_silver(layers.read_bronze(spark), layers, "old", "quarantine")
    return _silver_view(layers.read_silver(spark))


def _checked(spark: SparkSession, sf_dir: str) -> Layers:
    """Silver from payloads that land twice, with ranks above 8 set apart."""
    snapshots = daily(spark, sf_dir)
    landing, layers = scratch_path(spark, "landing"), Layers(scratch_path(spark, "layers"))
    for _ in range(2):
        land(snapshots, landing)
    jobs.write_bronze(read_payloads(spark, landing, multi_line=False), layers, "b1", ENDPOINT)
    jobs.write_silver(layers.read_bronze(spark), layers, "b1", "quarantine", max_rank=8)
    return layers


@query
def quarantine_layer(spark, sf_dir):
    """Listings that fail checks, ranks among them, with the names of the checks."""
    layers = _checked(spark, sf_dir)
    apart = tables.read_layer(
        spark, layers.quarantine, "symbol STRING, collected_at TIMESTAMP, cmc_rank INT, "
        "failed_checks ARRAY<STRING>",
    )
    return apart.select(
        "symbol", F.col("collected_at").cast("timestamp_ntz").alias("collected_at"), "cmc_rank",
        F.array_join("failed_checks", ",").alias("failed_checks"),
    )


@query
def silver_checks(spark, sf_dir):
    """The report of the checks that building Silver leaves behind."""
    return _checked(spark, sf_dir).read_notes(spark, "checks").drop("batch_id")


@query
def silver_counts(spark, sf_dir):
    """Rows before, set apart, removed and added, as building Silver has noted them."""
    return _checked(spark, sf_dir).read_notes(spark, "counts").drop("batch_id")


def _halves(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    low = F.coalesce(F.col("value") < 20, F.lit(False))
    return events.filter(low), events.filter(~low)


@query
def layer_roundtrip(spark, sf_dir):
    """Two appends, read back, then written again as a full rebuild."""
    events = table(spark, sf_dir, "events").withColumn("snapshot_date", F.to_date("ts"))
    appended, rebuilt = scratch_path(spark, "appended"), scratch_path(spark, "rebuilt")
    for part in _halves(events):
        tables.append(part, appended)
    tables.overwrite(tables.read_layer(spark, appended, events.schema), rebuilt)
    stored = tables.read_layer(spark, rebuilt, events.schema)
    return stored.withColumn("snapshot_date", _text("snapshot_date"))


@query
def csv_by_name(spark, sf_dir):
    """Two CSV layouts with differing column orders as one table."""
    events = table(spark, sf_dir, "events")
    one, two = scratch_path(spark, "csv"), scratch_path(spark, "csv")
    low, rest = _halves(events)
    tables.export_csv(low, one)
    tables.export_csv(rest.select(*reversed(rest.columns)), two)
    return tables.import_csv(spark, [one, two], events.schema)


@query
def csv_export(spark, sf_dir):
    """Gold as CSV and back; the numbers survive the text."""
    gold = to_gold(daily(spark, sf_dir), DAILY, "value", "low")
    path = scratch_path(spark, "csv")
    tables.export_csv(gold, path)
    back = tables.import_csv(spark, [path], gold.schema, lenient=False)
    return back.select(
        "user_id", _text("day").alias("day"), "value", "price_delta_pct",
        _r6("price_sma_7").alias("price_sma_7"), _r6("volatility_3").alias("volatility_3"),
    )


# --- streams ----------------------------------------------------------------------------


def _streamed(spark: SparkSession, sf_dir: str, last: str, replay: bool) -> Layers:
    """Lands the days in three stretches and lets the streams catch up after each."""
    landing, layers = scratch_path(spark, "landing"), Layers(scratch_path(spark, "layers"))
    stretches = day_thirds(stored_daily(spark, sf_dir))
    for i, stretch in enumerate(stretches):
        land(stretch, landing)
        if replay and i == 1:
            land(stretches[0], landing)
        streams.bronze_stream(spark, landing, layers, ENDPOINT, multi_line=False).awaitTermination()
        if last in ("silver", "gold"):
            streams.silver_stream(spark, layers).awaitTermination()
        if last == "gold":
            streams.gold_stream(spark, layers).awaitTermination()
    return layers


def _rewind(spark: SparkSession, layers: Layers) -> None:
    """Makes every stream believe that it died just before ending its last micro-batch."""
    for name in ("bronze", "silver", "gold"):
        folder = f"{layers.checkpoint(name)}/commits"
        last = max((n for n in files.names(spark, folder) if n.isdigit()), key=int)
        for file in (last, f".{last}.crc"):
            files.delete(spark, f"{folder}/{file}")


def _caught_up(spark: SparkSession, landing: str, layers: Layers) -> None:
    streams.bronze_stream(spark, landing, layers, ENDPOINT, multi_line=False).awaitTermination()
    streams.silver_stream(spark, layers).awaitTermination()
    streams.gold_stream(spark, layers).awaitTermination()


@query
def stream_retry(spark, sf_dir):
    """Row counts of all tables after every stream has run each last micro-batch twice, when
    the streams below had taken it already."""
    landing, layers = scratch_path(spark, "landing"), Layers(scratch_path(spark, "layers"))
    for stretch in day_thirds(daily(spark, sf_dir)):
        land(stretch, landing)
        _caught_up(spark, landing, layers)
        _rewind(spark, layers)
        _caught_up(spark, landing, layers)
    counted = {
        "bronze": layers.read_bronze(spark), "audit": layers.read_audit(spark),
        "silver": layers.read_silver(spark), "late": streams.read_late(spark, layers),
        "gold": streams.read_live_gold(spark, layers),
    }
    rows = [df.agg(F.lit(n).alias("layer"), F.count("*").alias("n")) for n, df in counted.items()]
    return reduce(DataFrame.unionByName, rows)


@query
def stream_late(spark, sf_dir):
    """Live Gold where the middle days come last."""
    landing, layers = scratch_path(spark, "landing"), Layers(scratch_path(spark, "layers"))
    first, middle, last = day_thirds(stored_daily(spark, sf_dir))
    for stretch in (first, last, middle):
        land(stretch, landing)
        _caught_up(spark, landing, layers)
    return _gold_view(streams.read_live_gold(spark, layers))


@query
def stream_bronze_raw(spark, sf_dir):
    bronze = _streamed(spark, sf_dir, "bronze", replay=False).read_bronze(spark)
    return _fields(bronze, "raw_json", ["symbol", "collected_at"], **_MORE_COIN)


@query
def stream_audit_errors(spark, sf_dir):
    audit = _streamed(spark, sf_dir, "bronze", replay=False).read_audit(spark)
    return _fields(audit, "raw_status", ["collected_at", "elapsed"], **_MORE_STATUS)


@query
def stream_bronze(spark, sf_dir):
    return _bronze_view(_streamed(spark, sf_dir, "bronze", replay=False).read_bronze(spark))


@query
def stream_silver(spark, sf_dir):
    """As the batch Silver, with the first stretch of payloads landing twice."""
    return _silver_view(_streamed(spark, sf_dir, "silver", replay=True).read_silver(spark))


@query
def stream_gold(spark, sf_dir):
    """As the batch Gold, built up over three rounds."""
    layers = _streamed(spark, sf_dir, "gold", replay=False)
    return _gold_view(streams.read_live_gold(spark, layers))


@query
def stream_dedup(spark, sf_dir):
    """Every event arrives twice; one copy leaves the stream."""
    events = table(spark, sf_dir, "events")
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "distinct")
    copies = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    copies.write.parquet(landing)
    stream = spark.readStream.schema(copies.schema).parquet(landing)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    kept = dedup.drop_replays(stream, ["user_id", "ts", "event_id"], "ts", "1 hour")
    (
        kept.drop("copy").writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "checkpoint"))
        .trigger(availableNow=True).start(out).awaitTermination()
    )
    stored = spark.read.parquet(out)
    return stored.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*events.columns)


# Queries of their own modules, which register themselves.
from tidemark.catalog import indicators, live, models, payloads  # noqa: E402, F401
