"""Queries of the stateful streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog.derived import ENDPOINT, day_thirds, land, stored_daily, table
from tidemark.catalog.registry import query, r6
from tidemark.plans.jobs import Layers
from tidemark.session import scratch_path
from tidemark.sources.schemas import GOLD_FEATURES
from tidemark.streaming import jobs as streams
from tidemark.streaming import stateful


@query
def stream_gold_stateful(spark, sf_dir):
    """Gold with rebased values from per-key state, the middle days coming last."""
    landing, layers = scratch_path(spark, "landing"), Layers(scratch_path(spark, "layers"))
    first, middle, last = day_thirds(stored_daily(spark, sf_dir))
    for stretch in (first, last, middle):
        land(stretch, landing)
        streams.bronze_stream(spark, landing, layers, ENDPOINT, multi_line=False).awaitTermination()
        streams.silver_stream(spark, layers).awaitTermination()
        # Every day is within this of the newest, so no row is too late.
        stateful.stateful_gold_stream(spark, layers, lateness_ms=10**13).awaitTermination()
    gold = stateful.read_stateful_gold(spark, layers).filter("NOT too_late")
    rounded = ("observed_log_return", "price_sma_3", "price_sma_7", "volatility_3")
    return gold.select(
        "symbol", F.col("collected_at").cast("timestamp_ntz").alias("collected_at"),
        *[r6(c).alias(c) if c in rounded else F.col(c) for c in GOLD_FEATURES],
        r6("rebased").alias("rebased"),
    )


@query
def stream_keep_first(spark, sf_dir):
    """Every event arrives three times, the later copies first and with other values; the first
    by their order leaves the stream."""
    events = table(spark, sf_dir, "events")
    landing, out = scratch_path(spark, "landing"), scratch_path(spark, "first")
    for copy in (2, 1, 0):
        copies = events.withColumns({"copy": F.lit(copy), "value": F.col("value") + copy})
        copies.write.mode("append").parquet(landing)
    # A later row lets the watermark pass the last of them; it stays behind itself.
    after = events.orderBy(F.desc("ts"), "event_id").limit(1).withColumns({
        "copy": F.lit(0), "ts": F.col("ts") + F.expr("INTERVAL 2 DAYS"),
    })
    after.write.mode("append").parquet(landing)
    stream = spark.readStream.schema(after.schema).parquet(landing)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    streams.distinct_stream(
        stream, out, scratch_path(spark, "checkpoint"), ["user_id", "ts", "event_id"], ["copy"],
        "ts", "1 hour",
    ).awaitTermination()
    stored = spark.read.parquet(out).drop("copy")
    return stored.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*events.columns)
