"""Window expressions over one key's rows in time order.

Each takes the ``WindowSpec`` of the history (key and order, no frame), so the same
expression runs over a whole key or over one part of a split hot key. Frames count
rows, not time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, WindowSpec, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import log_return


def micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def previous(value: Column, w: WindowSpec) -> Column:
    return F.lag(value).over(w)


def difference(value: Column, w: WindowSpec) -> Column:
    return value - previous(value, w)


def pct_change(value: Column, w: WindowSpec) -> Column:
    """Percent change against the row before; NULL after a NULL or zero value."""
    return (F.try_divide(value, previous(value, w)) - 1) * 100


def minutes_since_last(time: Column, w: WindowSpec) -> Column:
    """Minutes to the row before, with fractions down to the microsecond."""
    return difference(micros(time), w) / 60e6


def observed_log_return(value: Column, w: WindowSpec) -> Column:
    return log_return(pct_change(value, w))


def rolling(
    value: Column,
    rows: int,
    w: WindowSpec,
    fn: Callable[[Column], Column] = F.avg,
    min_periods: int = 1,
) -> Column:
    """``fn`` over the last ``rows`` rows, NULL with fewer than ``min_periods`` values."""
    frame = w.rowsBetween(-(rows - 1), Window.currentRow)
    result = fn(value).over(frame)
    if min_periods <= 1:
        return result
    return F.when(F.count(value).over(frame) >= min_periods, result)


def volatility(log_returns: Column, rows: int, w: WindowSpec) -> Column:
    """Sample standard deviation; Spark gives NULL for one value by itself."""
    return F.stddev_samp(log_returns).over(w.rowsBetween(-(rows - 1), Window.currentRow))
