"""Row-level expressions shared by the layers and the checks.

Division and logarithms follow one rule: where the result would be infinite or
undefined the value is NULL, so that later averages and ranks skip it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_time(c: str | Column, strict: bool = False) -> Column:
    """Timestamp from ISO-8601 text; junk gives NULL, or an error when strict."""
    return F.to_timestamp(_col(c)) if strict else F.try_to_timestamp(_col(c))


def member_flag(c: str | Column, members: Iterable[str]) -> Column:
    """Exact, case-sensitive membership; a NULL is no member."""
    return F.coalesce(_col(c).isin(*sorted(members)), F.lit(False))


def present_flag(c: str | Column) -> Column:
    return _col(c).isNotNull()


def log_return(pct: str | Column) -> Column:
    """ln(1 + pct/100); NULL at and below a change of -100 percent."""
    return F.log(1 + _col(pct) / 100)


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    return F.try_divide(_col(numerator), _col(denominator))


def nan_to_null(c: str | Column) -> Column:
    return F.nanvl(_col(c), F.lit(None).cast("double"))


def _holds(c: Column, condition: Column) -> Column:
    # Spark sorts NaN above every number, so "NaN > 0" holds unless it is ruled out.
    not_nan = ~F.isnan(c.cast("double"))
    return F.coalesce(not_nan & condition, F.lit(False))


def positive(c: str | Column) -> Column:
    return _holds(_col(c), _col(c) > 0)


def non_negative(c: str | Column) -> Column:
    return _holds(_col(c), _col(c) >= 0)


def in_range(c: str | Column, low, high) -> Column:
    """Inclusive on both ends."""
    return _holds(_col(c), _col(c).between(low, high))
