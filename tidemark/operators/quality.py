"""Row checks, their report, and three ways to act on them.

``enforce`` fails the job that writes the rows, before anything is committed;
``split_rows`` sets failing rows apart; ``check_report`` only counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalar import in_range, non_negative, positive


@dataclass(frozen=True)
class Check:
    """A named condition that must be true, not NULL, on every row."""

    name: str
    holds: Column


class QualityError(RuntimeError):
    pass


def snapshot_checks(max_rank: int | None = None) -> list[Check]:
    """Checks of a listings table; without ``max_rank`` a rank only has to be positive."""
    rank = positive("cmc_rank") if max_rank is None else in_range("cmc_rank", 1, max_rank)
    return [
        Check("price_positive", positive("quote_USD_price")),
        Check("market_cap_positive", positive("quote_USD_market_cap")),
        Check("volume_non_negative", non_negative("quote_USD_volume_24h")),
        Check("rank_in_range", rank),
        Check("collected_at_present", F.col("collected_at").isNotNull()),
    ]


def check_report(
    df: DataFrame, checks: Sequence[Check], unique: Sequence[str] | None = None
) -> DataFrame:
    """(check, passed, failing_rows) for each check in one pass; no rows passes all.

    With ``unique``, the rows are first counted per key, so key uniqueness costs one
    shuffle of the key and the counters, and copies of a hot key merge before it.
    """
    failing = [F.count_if(_fails(c)).alias(f"f{i}") for i, c in enumerate(checks)]
    names = [c.name for c in checks]
    if unique:
        per_key = df.groupBy(*unique).agg(F.count("*").alias("n"), *failing)
        totals = per_key.agg(
            *[F.sum(f"f{i}").alias(f"f{i}") for i in range(len(checks))],
            F.sum(F.col("n") - 1).alias(f"f{len(checks)}"),
        )
        names.append("unique_" + "_".join(unique))
    else:
        totals = df.agg(*failing)
    entries = []
    for i, name in enumerate(names):
        n = F.coalesce(F.col(f"f{i}"), F.lit(0)).cast("bigint")
        entries.append(
            F.struct(
                F.lit(name).alias("check"), (n == 0).alias("passed"), n.alias("failing_rows")
            )
        )
    return totals.select(F.inline(F.array(*entries)))


def _fails(check: Check) -> Column:
    return ~F.coalesce(check.holds, F.lit(False))


def failing_counters(checks: Sequence[Check]) -> list[Column]:
    """Aggregates failing_0, failing_1, ... and any_failing."""
    any_failing = F.lit(False)
    for check in checks:
        any_failing = any_failing | _fails(check)
    each = [F.count_if(_fails(c)).alias(f"failing_{i}") for i, c in enumerate(checks)]
    return [*each, F.count_if(any_failing).alias("any_failing")]


def gate(report: DataFrame) -> None:
    """Raises if any check of a report failed; the report has one row per check."""
    failed = report.filter(~F.col("passed")).collect()
    if failed:
        raise QualityError(", ".join(f"{r['check']}: {r['failing_rows']} rows" for r in failed))


def failed_checks(checks: Sequence[Check]) -> Column:
    """Names of the checks a row fails, as an array."""
    named = [F.when(_fails(c), F.lit(c.name)) for c in checks]
    return F.array_compact(F.array(*named))


def split_rows(
    df: DataFrame, checks: Sequence[Check], label: str = "failed_checks"
) -> tuple[DataFrame, DataFrame]:
    """(rows that pass every check, failing rows with the names of the checks)."""
    tagged = df.withColumn(label, failed_checks(checks))
    good = tagged.filter(F.size(label) == 0).drop(label)
    return good, tagged.filter(F.size(label) > 0)


def enforce(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """The same rows; running the result raises at the first row that fails a check."""
    stop = None
    for c in checks:
        bad = _fails(c)
        message = F.raise_error(F.lit(f"check failed: {c.name}")).cast("boolean")
        stop = F.when(bad, message) if stop is None else stop.when(bad, message)
    return df if stop is None else df.filter(stop.otherwise(F.lit(True)))


def _missing(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def null_counters(schema: T.StructType) -> list[Column]:
    """Aggregates nulls_0, nulls_1, ...: missing values by column."""
    return [F.count_if(_missing(f)).alias(f"nulls_{i}") for i, f in enumerate(schema.fields)]


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls, pct) of the columns that have any, most nulls first."""
    fields = df.schema.fields
    counts = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(_missing(f)).alias(f"n{i}") for i, f in enumerate(fields)],
    )
    entries = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.col(f"n{i}").alias("nulls"),
            (F.try_divide(F.col(f"n{i}"), F.col("rows")) * 100).alias("pct"),
        )
        for i, f in enumerate(fields)
    ]
    return (
        counts.select(F.inline(F.array(*entries)))
        .filter("nulls > 0")
        .orderBy(F.desc_nulls_last("nulls"), "column")
    )
