"""Queries of what payloads hold beyond the declared schemas, and of merged summaries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.catalog.derived import ENDPOINT, daily, day_thirds, land
from tidemark.catalog.registry import query, r6
from tidemark.operators import nested
from tidemark.plans import jobs
from tidemark.plans.jobs import Layers
from tidemark.session import scratch_path
from tidemark.sources.landing import read_payloads
from tidemark.sources.schemas import COIN

_MORE = T.StructType([
    T.StructField("slug", T.StringType()), T.StructField("num_market_pairs", T.LongType()),
])


def _landed(spark, sf_dir):
    landing, layers = scratch_path(spark, "landing"), Layers(scratch_path(spark, "layers"))
    land(daily(spark, sf_dir), landing)
    return landing, layers


@query
def payload_schema(spark, sf_dir):
    """Fields of the listings that no schema declares, with their types and how often they come."""
    landing, layers = _landed(spark, sf_dir)
    jobs.write_bronze(read_payloads(spark, landing, multi_line=False), layers, "b1", ENDPOINT)
    return nested.undeclared_fields(layers.read_bronze(spark), "raw_json", COIN.names)


@query
def gold_wider(spark, sf_dir):
    """Further listing fields as typed columns all the way to Gold, beside its features."""
    landing, layers = _landed(spark, sf_dir)
    jobs.run_cycle(
        spark, landing, layers, "c1", ENDPOINT, mode="quarantine", multi_line=False,
        coin=T.StructType([*COIN.fields, *_MORE.fields]),
    )
    return layers.read_gold(spark, _MORE).select(
        "symbol", F.col("collected_at").cast("timestamp_ntz").alias("collected_at"), *_MORE.names,
        r6("price_sma_7").alias("price_sma_7"), "dominance_delta",
    )


@query
def malformed_payloads(spark, sf_dir):
    """The texts of payloads that break off, kept in the audit table beside those that do not."""
    landing, layers = _landed(spark, sf_dir)
    broken = daily(spark, sf_dir).select(F.concat(
        F.lit('{"status": {"elapsed": '), F.col("n_events").cast("string"),
        F.lit('}, "data": [{"symbol": "K'), F.col("user_id").cast("string"),
    ).alias("value"))
    broken.write.mode("append").text(landing)
    jobs.write_bronze(read_payloads(spark, landing, multi_line=False), layers, "b1", ENDPOINT)
    return layers.read_audit(spark).groupBy("malformed", "raw_payload").agg(
        F.count("*").alias("payloads")
    )


@query
def merged_overview(spark, sf_dir):
    """The overview of Silver from the summaries of three batches, without a scan of its rows."""
    landing, layers = scratch_path(spark, "landing"), Layers(scratch_path(spark, "layers"))
    for i, stretch in enumerate(day_thirds(daily(spark, sf_dir))):
        folder = f"{landing}/{i}"
        land(stretch, folder)
        jobs.write_bronze(
            read_payloads(spark, folder, multi_line=False), layers, f"b{i}", ENDPOINT)
        bronze = layers.read_bronze(spark).filter(F.col("batch_id") == f"b{i}")
        jobs.write_silver(bronze, layers, f"b{i}", "quarantine")
    times = ("first_time", "last_time")
    return jobs.overview(spark, layers).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in times})
