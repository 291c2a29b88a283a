"""De-duplication on a key, keeping the first row of a stated order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_RANK, _NEW, _SHARE = "_copy_rank", "_is_new", "_share"


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, NULL keys being equal, the first by ``order`` with NULLs last.

    The rank filter also runs before the shuffle, so a key with very many copies sends
    one row per map task.
    """
    by_key = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return (
        df.withColumn(_RANK, F.row_number().over(by_key))
        .filter(F.col(_RANK) == 1)
        .drop(_RANK)
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row counts as ``copies``."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def dedup_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before and after de-duplication, and how many it removes, as one row."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.count("*").alias("rows_after"),
    ).withColumn("removed", F.col("rows_before") - F.col("rows_after"))


def drop_replays(
    df: DataFrame, keys: Sequence[str], time: str, lateness: str, shares: int = 32
) -> DataFrame:
    """A stream without the replays that arrive within ``lateness`` of another copy.

    Any one copy stays, not the first by some order: copies are taken to be alike.

    A stream cannot cut copies down before its shuffle, so they are first dropped within
    random shares; a row with very many copies thus meets many tasks, and at most one copy
    per share goes on to the second pass. ``shares=1`` leaves the first pass out.
    """
    marked = df.withWatermark(time, lateness)
    if shares > 1:
        share = F.floor(F.rand() * shares).cast("int")
        marked = (
            marked.withColumn(_SHARE, share)
            .dropDuplicatesWithinWatermark([*keys, _SHARE])
            .drop(_SHARE)
        )
    return marked.dropDuplicatesWithinWatermark(list(keys))


def first_arrivals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], time: str, lateness: str
) -> DataFrame:
    """A stream with one row per key, the first by ``order`` with NULLs last, NULL keys being equal.

    ``time`` is one of the keys, so the copies of a row share it. Each key's first row so far is
    kept until the watermark, ``lateness`` behind the newest time, has passed that time; then it
    leaves, once. Copies that come later than that are dropped. Rows without a time never leave,
    since no watermark passes them. Copies also shrink before the shuffle, to one row per map
    task, so a row with very many copies is no hot key.
    """
    if time not in keys:
        raise ValueError(f"the time column {time!r} has to be one of the keys")
    place = F.struct(*[c for o in order for c in (F.col(o).isNull(), F.col(o))])
    whole = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.withWatermark(time, lateness)
        .groupBy(*[F.col(k).alias(f"_key_{i}") if k != time else F.col(k) for i, k in enumerate(keys)])
        .agg(F.min_by(whole, place).alias("_first"))
        .select("_first.*")
    )


def keep_first_new(
    df: DataFrame, stored: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """The first row of each key that ``stored`` does not hold, NULL keys being equal.

    Stored keys take part as the earliest arrivals, so this costs the one shuffle of
    ``keep_first`` and no join.
    """
    seen = stored.select(*keys).withColumn(_NEW, F.lit(False))
    both = df.withColumn(_NEW, F.lit(True)).unionByName(seen, allowMissingColumns=True)
    return keep_first(both, keys, [_NEW, *order]).filter(_NEW).drop(_NEW)
