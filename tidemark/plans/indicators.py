"""Indicators along each key's history, by their published definitions.

Missing values are passed over: an average keeps its last value there, and a change is counted
only where it exists. Any key may be cut, and gives the values of the uncut history.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions import scalar, series
from tidemark.operators.history import (
    CutPoints, Timeline, carried_forward, over_history, over_prefix,
)
from tidemark.operators.scan import linear_scan

_SEEN, _CHANGE, _FILLED = "_values_seen", "_change", "_filled"


def exponential_averages(
    df: DataFrame, value: str, spans: Mapping[str, int], timeline: Timeline = Timeline(),
    cuts: CutPoints | None = None,
) -> DataFrame:
    """Adds for each name the average with weight ``2 / (span + 1)`` for the newest value; it
    starts at the first value."""
    x, steps = F.col(value), {}
    for out, span in spans.items():
        alpha = 2.0 / (span + 1)
        steps[out] = (F.when(x.isNotNull(), F.lit(1.0 - alpha)), x * alpha, x)
    return linear_scan(df, steps, timeline, cuts)


def macd(
    df: DataFrame, value: str = "quote_USD_price", timeline: Timeline = Timeline(),
    cuts: CutPoints | None = None, fast: int = 12, slow: int = 26, signal: int = 9,
) -> DataFrame:
    """Adds ema_fast, ema_slow, macd (their difference), macd_signal (its average) and
    macd_histogram (macd less its signal)."""
    rows = exponential_averages(
        df, value, {"ema_fast": fast, "ema_slow": slow}, timeline, cuts
    ).withColumn("macd", F.when(F.col(value).isNotNull(), F.col("ema_fast") - F.col("ema_slow")))
    rows = exponential_averages(rows, "macd", {"macd_signal": signal}, timeline, cuts)
    line = F.col("ema_fast") - F.col("ema_slow")
    return rows.withColumn("macd", line).withColumn(
        "macd_histogram", F.col("macd") - F.col("macd_signal")
    )


def wilder_rsi(
    df: DataFrame, value: str = "quote_USD_price", timeline: Timeline = Timeline(),
    cuts: CutPoints | None = None, periods: int = 14, out: str = "rsi",
) -> DataFrame:
    """Adds the relative strength index with Wilder's smoothing.

    The averages of gains and losses start at the plain means of the first ``periods`` changes
    and go on by ``(periods - 1) / periods`` of themselves plus the newest one's share. NULL before
    that, and where there were neither gains nor losses.
    """
    changed = over_history(
        df,
        lambda rows, w: rows.withColumn(
            _CHANGE, timeline.masked(series.difference(F.col(value), w))
        ),
        timeline, 1, [value], cuts,
    )
    moves = {
        "_gain": F.greatest(F.col(_CHANGE), F.lit(0.0)),
        "_loss": F.greatest(-F.col(_CHANGE), F.lit(0.0)),
    }
    # greatest() passes over NULLs, so a missing change would count as none.
    moves = {n: F.when(F.col(_CHANGE).isNotNull(), c) for n, c in moves.items()}
    changed = changed.withColumns(moves)
    totals = {
        "_n_before": F.count(_CHANGE), "_gain_before": F.sum("_gain"), "_loss_before": F.sum("_loss"),
    }

    def summed(rows: DataFrame, w: WindowSpec) -> DataFrame:
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        none = F.lit(0)
        return rows.withColumns({
            _SEEN: F.count(_CHANGE).over(upto) + F.coalesce("_n_before", none),
            **{f"{c}_sum": F.coalesce(F.sum(c).over(upto), none) + F.coalesce(f"{c}_before", none)
               for c in moves},
        })

    rows = over_prefix(changed, summed, timeline, totals, lambda c, w: F.sum(c).over(w), cuts)
    keep, known = (periods - 1) / periods, F.col(_CHANGE).isNotNull()

    def steps(move: str) -> tuple[Column, Column]:
        start = F.col(_SEEN) <= periods
        a = F.when(known, F.when(start, F.lit(0.0)).otherwise(F.lit(keep)))
        b = F.when(start, F.col(f"{move}_sum")).otherwise(F.col(move)) / periods
        return a, F.when(known, b)

    rows = linear_scan(rows, {"_up": steps("_gain"), "_down": steps("_loss")}, timeline, cuts)
    strength = scalar.ratio(F.col("_up"), F.col("_up") + F.col("_down")) * 100
    return rows.withColumn(out, F.when(F.col(_SEEN) >= periods, strength)).select(*df.columns, out)


def bollinger(
    df: DataFrame, value: str = "quote_USD_price", timeline: Timeline = Timeline(),
    cuts: CutPoints | None = None, rows: int = 20, width: float = 2.0,
) -> DataFrame:
    """Adds band_middle, the mean of the last rows, and band_low and band_high, so many
    population deviations from it; NULL before there are ``rows`` values."""
    def bands(part: DataFrame, w: WindowSpec) -> DataFrame:
        mean = series.rolling(F.col(value), rows, w, F.avg, rows)
        spread = series.rolling(F.col(value), rows, w, F.stddev_pop, rows) * width
        return part.withColumns({
            "band_middle": timeline.masked(mean),
            "band_low": timeline.masked(mean - spread),
            "band_high": timeline.masked(mean + spread),
        })

    return over_history(df, bands, timeline, rows - 1, [value], cuts)


def anomalies(
    df: DataFrame, value: str = "observed_log_return", timeline: Timeline = Timeline(),
    cuts: CutPoints | None = None, rows: int = 20, least: int = 5, limit: float = 3.0,
) -> DataFrame:
    """Adds z_score, the distance of a value from the mean of the ``rows`` before it in their
    sample deviations, and is_anomaly, whether that exceeds ``limit``.

    NULL with fewer than ``least`` values before, or where these do not vary; no anomaly then.
    """
    def scored(part: DataFrame, w: WindowSpec) -> DataFrame:
        frame = w.rowsBetween(-rows, -1)
        enough = F.count(value).over(frame) >= least
        away = F.col(value) - F.avg(value).over(frame)
        score = F.when(enough, scalar.ratio(away, F.stddev_samp(value).over(frame)))
        return part.withColumn("z_score", timeline.masked(score))

    out = over_history(df, scored, timeline, rows, [value], cuts)
    return out.withColumn("is_anomaly", F.coalesce(F.abs("z_score") > limit, F.lit(False)))


def filled_pct_change(
    df: DataFrame, value: str = "quote_USD_price", timeline: Timeline = Timeline(),
    cuts: CutPoints | None = None, out: str = "price_delta_pct",
) -> DataFrame:
    """Adds the percent change between values carried forward over missing ones: 0 where a value
    is missing, and measured from the last one that was there where it is not."""
    filled = carried_forward(df, value, timeline, _FILLED, cuts)
    return over_history(
        filled,
        lambda rows, w: rows.withColumn(
            out, timeline.masked(series.pct_change(F.col(_FILLED), w))
        ),
        timeline, 1, [_FILLED], cuts,
    ).drop(_FILLED)
