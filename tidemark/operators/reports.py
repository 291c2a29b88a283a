"""Latest-snapshot rankings and table summaries."""

from __future__ import annotations

import datetime
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.series import micros

_RANK, _SALT = "_rank", "_salt"


def latest_snapshot(
    df: DataFrame, time: str = "collected_at", date: str | None = None,
    on: datetime.date | None = None, times: DataFrame | None = None,
) -> DataFrame:
    """Rows at the table's last time.

    ``date`` names a partition column to prune by; ``on`` is its last value, where known from
    the listing of the table. ``times`` is what the last time is read from, if that is
    cheaper than the table: the source of a table that is computed.
    """
    if date is not None:
        last = df.select(F.max(date)).scalar() if on is None else F.lit(on)
        df = df.filter(F.col(date) == last)
    return df.filter(F.col(time) == (df if times is None else times).select(F.max(time)).scalar())


def ranked_report(
    df: DataFrame, columns: Sequence[str], by: str, ties: Sequence[str] = ()
) -> DataFrame:
    """The columns, largest ``by`` first and NULLs last."""
    order = [F.col(by).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ties]]
    return df.select(*columns).orderBy(*order)


def latest_movers(
    gold: DataFrame, key: str = "symbol", time: str = "collected_at",
    value: str = "quote_USD_price", **latest,
) -> DataFrame:
    """``latest`` are the settings of ``latest_snapshot``, here and below."""
    columns = [key, value, "price_delta_pct", "minutes_since_last"]
    return ranked_report(latest_snapshot(gold, time, **latest), columns, "price_delta_pct", [key])


def latest_volatility(
    gold: DataFrame, key: str = "symbol", time: str = "collected_at",
    value: str = "quote_USD_price", flag: str = "is_stablecoin", **latest,
) -> DataFrame:
    rows = latest_snapshot(gold, time, **latest).filter(~F.col(flag))
    return ranked_report(rows, [key, value, "volatility_3"], "volatility_3", [key])


def latest_dominance(
    gold: DataFrame, key: str = "symbol", time: str = "collected_at",
    share: str = "quote_USD_market_cap_dominance", **latest,
) -> DataFrame:
    columns = [key, share, "dominance_delta"]
    return ranked_report(latest_snapshot(gold, time, **latest), columns, share, [key])


def key_history(
    gold: DataFrame, key_value, columns: Sequence[str], key: str = "symbol",
    time: str = "collected_at",
) -> DataFrame:
    """One key's rows in time order; the filter reaches the scan."""
    return gold.filter(F.col(key) == key_value).select(*columns).orderBy(time)


def top_per_snapshot(
    df: DataFrame, snapshot: str, order: Sequence[Column], start: int = 1, limit: int = 10,
    rank: str = "rank", one_pass: int = 100, salts: int = 512,
) -> DataFrame:
    """Ranks ``start`` to ``start + limit - 1`` of each snapshot, with the rank.

    Spark filters small ranks before the shuffle by itself, which leaves up to one slice per
    map task for the task that ranks a huge snapshot. Slices that end beyond ``one_pass`` are
    cut down twice: within ``salts`` shares of a snapshot, then over what is left of them.
    """
    last = start + limit - 1
    if last > one_pass:
        shares = Window.partitionBy(snapshot, _SALT).orderBy(*order)
        df = (
            df.withColumn(_SALT, F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
            .withColumn(_RANK, F.row_number().over(shares))
            .filter(F.col(_RANK) <= last)
            .drop(_RANK, _SALT)
        )
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(snapshot).orderBy(*order)))
    return ranked.filter((F.col(rank) >= start) & (F.col(rank) <= last))


_KLL, _STEP = 2048, 1.25
# Ranks that a sketch may be off by, as a share of all rows, in 99 of 100 cases.
_KLL_ERROR = 2.446 / _KLL**0.9433
MAX_THRESHOLDS = 100_000


def deep_slice(
    df: DataFrame, snapshot: str, by: str, ties: Sequence[str] = (), start: int = 1,
    limit: int = 10, descending: bool = True, rank: str = "rank",
) -> DataFrame:
    """Ranks ``start`` to ``start + limit - 1`` of each snapshot by a number and ``ties``.

    A quantile sketch per snapshot gives a threshold that the wanted ranks should lie above. Only
    rows above it are shuffled to be ranked, about the slice and one percent of the rows; where
    these are too few, the ranks go on below. The largest 100,000 snapshots get a threshold, which
    bounds what is broadcast. NULLs come last.
    """
    last = start + limit - 1
    value = F.col(by).cast("double") * (1 if descending else -1)
    narrow = df.select(F.col(snapshot).alias("_of"), value.alias("_value")).filter(
        "_value IS NOT NULL AND NOT isnan(_value)"
    )
    sketched = (
        narrow.groupBy("_of")
        .agg(F.count("_value").alias("_n"), F.kll_sketch_agg_double("_value", _KLL).alias("_s"))
        .filter(F.col("_n") > 2 * last)
        .orderBy(F.desc("_n"))
        .limit(MAX_THRESHOLDS)
    )
    share = (F.lit(float(last)) / F.col("_n")) + 2 * _KLL_ERROR
    # A sketch is asked for fixed shares only, so the next larger of these is taken.
    grid = [_STEP**-i for i in range(1 + int(math.log(1 / _KLL_ERROR, _STEP)))]
    at = F.floor(-F.ln(share) / math.log(_STEP)).cast("int")
    quantiles = F.kll_sketch_get_quantile_double("_s", F.array(*[F.lit(1.0 - g) for g in grid]))
    floors = F.broadcast(
        sketched.filter(share < 1).select("_of", F.get(quantiles, at).alias("_floor"))
    )
    # NaN sorts above all numbers: first in descending order, behind them in ascending order.
    over = F.coalesce(value >= F.col("_floor"), F.lit(False))
    over = over if descending else over & ~F.isnan(value)
    direction = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    order = [direction, *[F.col(c).asc_nulls_last() for c in ties]]
    number = F.row_number().over(Window.partitionBy(snapshot).orderBy(*order))
    columns = [*df.columns, rank]
    here = F.col(snapshot) == F.col("_of")
    ranked = (
        df.join(floors, here, "left")
        .filter(F.col("_floor").isNull() | over)
        .withColumn(rank, number)
    )
    # Where a sketch was too far off, the ranks go on below its threshold; mostly there are none.
    short = (
        ranked.filter("_floor IS NOT NULL")
        .groupBy("_of", "_floor")
        .agg(F.max(rank).alias("_found"))
        .filter(F.col("_found") < last)
    )
    below = df.join(F.broadcast(short), here).filter(~over).withColumn(
        rank, number + F.col("_found")
    )
    both = ranked.select(*columns).unionByName(below.select(*columns))
    return both.filter((F.col(rank) >= start) & (F.col(rank) <= last))


def data_overview(
    df: DataFrame, key: str = "symbol", time: str = "collected_at", approximate: bool = False
) -> DataFrame:
    """Distinct keys and snapshots, first and last time, and whole minutes between them.

    ``approximate`` counts distinct values by sketch, without shuffling them.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    span = micros(F.col("last_time")) - micros(F.col("first_time"))
    return df.agg(
        distinct(key).alias("keys"),
        distinct(time).alias("snapshots"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    ).withColumn("span_minutes", F.floor(span / 60e6))


# Distinct counts by sketch are exact, but for chance, up to some ten thousand values, and off by
# 0.1 percent (one standard error) beyond.
SKETCH = 20


def summary(
    df: DataFrame, key: str = "symbol", time: str = "collected_at"
) -> DataFrame:
    """One row that says of some rows what ``merged_overview`` needs: their number, sketches of
    the distinct keys and times, first and last time."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.hll_sketch_agg(F.col(key).cast("string"), SKETCH).alias("keys"),
        F.hll_sketch_agg(micros(F.col(time)), SKETCH).alias("snapshots"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
    )


def merged_overview(summaries: DataFrame) -> DataFrame:
    """``data_overview`` with the number of rows, from summaries of any parts of a table."""
    span = micros(F.col("last_time")) - micros(F.col("first_time"))
    return summaries.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        *[
            F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0)).alias(c)
            for c in ("keys", "snapshots")
        ],
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    ).withColumn("span_minutes", F.floor(span / 60e6))


def snapshot_times(df: DataFrame, time: str = "collected_at") -> DataFrame:
    return df.select(time).distinct().orderBy(time)


def table_profile(df: DataFrame) -> DataFrame:
    """(position, column, dtype, row_count, column_count), one row per column."""
    entries = [
        F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(dtype).alias("dtype")
        )
        for i, (name, dtype) in enumerate(df.dtypes)
    ]
    return df.agg(F.count("*").alias("row_count")).select(
        F.inline(F.array(*entries)), "row_count", F.lit(len(entries)).alias("column_count")
    )


def new_columns(after: DataFrame, before: DataFrame, counts: bool = False) -> DataFrame:
    """Columns of ``after`` that ``before`` lacks, by name; no rows if there are none.

    Schemas say that. Only with ``counts`` are the rows read, to count them and the values.
    """
    added = sorted(set(after.columns) - set(before.columns))
    width = F.lit(len(after.columns)).alias("column_count")
    if not counts or not added:
        named = after.sparkSession.createDataFrame([(c,) for c in added], "column STRING")
        none = [F.lit(0).cast("bigint").alias(c) for c in ("values", "row_count") if counts]
        return named.select("column", *none, width).orderBy("column")
    totals = after.agg(
        F.count("*").alias("row_count"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(added)]
    )
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("values"))
        for i, c in enumerate(added)
    ]
    return totals.select(
        F.inline(F.array(*entries)),
        "row_count",
        width,
    ).orderBy("column")
