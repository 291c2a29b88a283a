"""Snapshot-shaped data that Spark derives from the ``events`` table.

``daily`` reduces events to one row per user and day, as one row per coin and snapshot.
``land`` writes the daily rows as listing payloads, paged as a listings endpoint pages
them, so no payload holds more than ``PAGE`` records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.history import Timeline
from tidemark.session import scratch_path

PAGE = 100
ENDPOINT = "landing/listings"

EVENTS = Timeline("user_id", "ts", ("event_id",))
DAILY = Timeline("user_id", "day")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.count("*").alias("n_events"),
    )


def stored_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``daily`` as a table, for queries that take it stretch by stretch."""
    path = scratch_path(spark, "daily")
    daily(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def symbol_of(user: Column) -> Column:
    return (
        F.when(user == 1, "USDT").when(user == 2, "USDC").when(user == 3, "DAI")
        .otherwise(F.concat(F.lit("K"), user.cast("string")))
    )


def payloads(snapshots: DataFrame) -> DataFrame:
    """One payload per day and page: ``status``, ``data`` and the collection time.

    Both have fields that no schema declares.
    """
    user, day = F.col("user_id"), F.col("day").cast("string")
    updated = F.concat(day, F.lit("T10:30:00.250Z"))
    coin = F.struct(
        symbol_of(user).alias("symbol"),
        F.concat(F.lit("key "), user.cast("string")).alias("name"),
        (user % 10 + 1).cast("int").alias("cmc_rank"),
        F.col("n_events").cast("double").alias("circulating_supply"),
        F.when(user % 4 != 0, F.col("high") + 1000.0).alias("max_supply"),
        F.when(user % 5 == 0, F.col("low")).alias("tvl_ratio"),
        F.concat(day, F.lit("T00:00:00.000Z")).alias("date_added"),
        F.when(user % 7 == 0, "junk").otherwise(updated).alias("last_updated"),
        F.when(user % 3 == 0, F.struct(user.alias("id"))).alias("platform"),
        F.concat(F.lit("key-"), user.cast("string")).alias("slug"),
        F.col("n_events").alias("num_market_pairs"),
        F.struct(
            F.struct(
                F.col("value").alias("price"),
                (F.col("low") - F.col("high")).alias("percent_change_1h"),
                (F.col("high") - F.col("low")).alias("percent_change_24h"),
                F.col("low").alias("percent_change_7d"),
                (F.col("high") * 1000.0).alias("market_cap"),
                (F.col("high") * F.col("n_events")).alias("volume_24h"),
                F.col("low").alias("market_cap_dominance"),
                updated.alias("last_updated"),
            ).alias("USD")
        ).alias("quote"),
    )
    # At most PAGE users share a page and a user has one row per day.
    paged = snapshots.groupBy("day", F.floor(user / PAGE).alias("page")).agg(
        F.array_sort(F.collect_list(coin)).alias("data")
    )
    return paged.select(
        "day",
        F.struct(
            F.lit(1).alias("credit_count"),
            F.size("data").alias("total_count"),
            F.col("page").cast("int").alias("elapsed"),
            F.when(F.col("page") % 2 == 1, F.lit(1000) + F.col("page")).alias("error_code"),
            F.when(
                F.col("page") % 2 == 1, F.concat(F.lit("page "), F.col("page").cast("string"))
            ).alias("error_message"),
        ).alias("status"),
        "data",
        F.concat(F.col("day").cast("string"), F.lit("T12:00:00+00:00")).alias("collected_at"),
    )


def land(snapshots: DataFrame, path: str) -> None:
    """Adds the payloads of these daily rows to a landing folder, one per line."""
    payloads(snapshots).drop("day").write.mode("append").json(path)


def land_copies(snapshots: DataFrame, path: str, apart: bool) -> None:
    """Every payload twice, the second time with lower prices: next to the first one in its
    file, or ``apart`` in a later file."""
    lower = snapshots.withColumn("value", F.col("value") - 1)
    if apart:
        land(snapshots, path)
        land(lower, path)
        return
    both = payloads(snapshots).withColumn("copy", F.lit(0)).unionByName(
        payloads(lower).withColumn("copy", F.lit(1))
    )
    ordered = both.repartition("day").sortWithinPartitions("day", "status.elapsed", "copy")
    ordered.drop("day", "copy").write.mode("append").json(path)


def day_thirds(snapshots: DataFrame) -> list[DataFrame]:
    """The rows as three consecutive stretches of days, none left out."""
    first, last = snapshots.agg(F.min("day"), F.max("day")).first()
    third = (last - first) / 3
    one, two = first + third, first + 2 * third
    day = F.col("day")
    return [
        snapshots.filter(day <= F.lit(one)),
        snapshots.filter((day > F.lit(one)) & (day <= F.lit(two))),
        snapshots.filter((day > F.lit(two)) | day.isNull()),
    ]
