"""Queries of the indicators, over events of which those of type ``error`` have no value."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog.derived import EVENTS, table
from tidemark.catalog.registry import query, r6
from tidemark.operators.history import find_cut_points
from tidemark.plans import indicators
from tidemark.plans.layers import to_gold

_PER_PART = 500


def _gappy(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    """Events with missing values; ``hot`` merges a third of the users into one key."""
    user = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        "event_id", "ts",
        (F.when(user % 3 == 0, F.lit(0)).otherwise(user) if hot else user).alias("user_id"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
    )


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select("event_id", "user_id", *[r6(c).alias(c) for c in names])


_MACD = ("ema_fast", "ema_slow", "macd", "macd_signal", "macd_histogram")


@query
def ema_surface(spark, sf_dir):
    """Exponential averages over all of a key's history, and the MACD made of them."""
    events = _gappy(spark, sf_dir)
    return _rounded(indicators.macd(events, "value", EVENTS, find_cut_points(events, EVENTS)), *_MACD)


@query
def hot_key_ema(spark, sf_dir):
    """The same over a key with a third of all rows, which is cut up."""
    events = _gappy(spark, sf_dir, hot=True)
    cuts = find_cut_points(events, EVENTS, _PER_PART)
    return _rounded(indicators.macd(events, "value", EVENTS, cuts), *_MACD)


@query
def wilder_rsi(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    cuts = find_cut_points(events, EVENTS)
    return _rounded(indicators.wilder_rsi(events, "value", EVENTS, cuts), "rsi")


@query
def hot_key_rsi(spark, sf_dir):
    events = _gappy(spark, sf_dir, hot=True)
    cuts = find_cut_points(events, EVENTS, _PER_PART)
    return _rounded(indicators.wilder_rsi(events, "value", EVENTS, cuts), "rsi")


@query
def bollinger_bands(spark, sf_dir):
    events = _gappy(spark, sf_dir)
    cuts = find_cut_points(events, EVENTS)
    bands = indicators.bollinger(events, "value", EVENTS, cuts, rows=10)
    return _rounded(bands, "band_middle", "band_low", "band_high")


@query
def anomaly_flags(spark, sf_dir):
    """Values far from the mean of those before them."""
    events = _gappy(spark, sf_dir)
    scored = indicators.anomalies(events, "value", EVENTS, find_cut_points(events, EVENTS), limit=2.0)
    return scored.select("event_id", "user_id", r6("z_score").alias("z_score"), "is_anomaly")


@query
def filled_changes(spark, sf_dir):
    """Percent changes over missing values."""
    events = _gappy(spark, sf_dir)
    changes = indicators.filled_pct_change(events, "value", EVENTS, find_cut_points(events, EVENTS))
    return _rounded(changes, "price_delta_pct")


@query
def hot_key_filled(spark, sf_dir):
    """All features with percent changes over missing values, a key with a third of the rows
    among them, which is cut where values may be missing."""
    events = _gappy(spark, sf_dir, hot=True)
    cuts = find_cut_points(events, EVENTS, _PER_PART)
    gold = to_gold(events, EVENTS, "value", None, cuts, fill=True)
    return _rounded(gold, "price_delta_pct", "observed_log_return", "volatility_3", "price_sma_3")
