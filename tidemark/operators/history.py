"""Window work over each key's time-ordered history, also where one key is huge.

A window partitioned by the key alone puts a key's whole history into one task. The
series features only look back a few rows, so a hot key can be cut along its order:
every part gets the few rows before its start as a lead-in, the same window
expressions run inside each part, and the lead-in rows are dropped again. No row of
the input is left out and every result equals that of the uncut window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.series import micros

ROWS_PER_PART = 5_000_000
MAX_PARTS = 100_000  # bounds the broadcast list of cut points, whatever the table's size
NULL_KEY_PARTS = 1_024
_SAMPLES_PER_PART = 100

_KEY, _CUTS, _PART, _LEAD, _RANK = "_cut_key", "_cuts", "_part", "_lead_in", "_part_rank"
_HEADS, _CHUNK, _CHUNK_KEY, _BEFORE = "_heads", "_chunk", "_chunk_key", "_before_chunk"

Compute = Callable[[DataFrame, WindowSpec], DataFrame]


@dataclass(frozen=True)
class Timeline:
    """Names the key, the time column and what settles the order among equal times.

    Time and ties together should order a key's rows fully; rows they leave equal have
    no order that two runs would agree on.
    """

    key: str = "symbol"
    time: str = "collected_at"
    ties: tuple[str, ...] = ()

    @property
    def order(self) -> list[str]:
        return [self.time, *self.ties]

    def window(self, *more_keys: str) -> WindowSpec:
        return Window.partitionBy(self.key, *more_keys).orderBy(
            *[F.col(c).asc_nulls_last() for c in self.order]
        )

    def position(self, df: DataFrame) -> Column:
        """One comparable value per row that sorts as the window does."""
        fields = []
        for i, c in enumerate(self.order):
            # As a number a timestamp reaches the driver and returns without a time zone.
            zoned = isinstance(df.schema[c].dataType, T.TimestampType)
            fields.append(F.col(c).isNull().alias(f"n{i}"))
            fields.append((micros(F.col(c)) if zoned else F.col(c)).alias(f"v{i}"))
        return F.struct(*fields)

    def masked(self, value: Column) -> Column:
        """Rows without a key belong to no history and get no value."""
        return F.when(F.col(self.key).isNotNull(), value)


@dataclass(frozen=True)
class CutPoints:
    """Where hot keys are cut, in two levels.

    ``chunks`` has the sorted positions of a key in chunks of about the square root of their
    number; ``heads`` has the first position of each chunk, one row per hot key. A row thus
    looks into two short lists, however many cuts its key has.
    """

    heads: DataFrame
    chunks: DataFrame
    most_heads: int
    most_cuts: int


def find_cut_points(
    df: DataFrame, timeline: Timeline, rows_per_part: int = ROWS_PER_PART,
    max_parts: int = MAX_PARTS,
) -> CutPoints | None:
    """Cut points about every ``rows_per_part`` rows of a key, or None if no key needs any.

    Runs a count, and for tables above one part a scan of the key and order columns.
    The sample only places the cuts, as range partitioning does; it never decides which
    rows are computed. The spacing widens with the table, so at most about ``max_parts``
    positions reach the driver.
    """
    rows = df.count()
    if rows <= rows_per_part:
        return None
    spacing = max(rows_per_part, -(-rows // max_parts))
    fraction = min(1.0, _SAMPLES_PER_PART / spacing)
    every = max(1, round(spacing * fraction))
    by_key = Window.partitionBy(_KEY).orderBy("position")
    sample = df.select(F.col(timeline.key).alias(_KEY), timeline.position(df).alias("position"))
    if fraction < 1.0:
        sample = sample.sample(fraction, seed=7)
    cuts = (
        sample.withColumn("rank", F.row_number().over(by_key))
        .filter(F.col("rank") % every == 0)
        .groupBy(_KEY)
        .agg(F.array_sort(F.collect_set("position")).alias(_CUTS))
    )
    found = cuts.collect()
    if not found:
        return None
    return _two_levels(df.sparkSession, found, cuts.schema)


def _two_levels(spark: SparkSession, found: list, schema: T.StructType) -> CutPoints:
    heads, chunks = [], []
    for row in found:
        positions = row[_CUTS]
        size = max(1, math.isqrt(len(positions)))
        begins = range(0, len(positions), size)
        heads.append((row[_KEY], [positions[b] for b in begins]))
        chunks += [(row[_KEY], n + 1, b, positions[b : b + size]) for n, b in enumerate(begins)]
    key, positions = schema[_KEY], schema[_CUTS].dataType
    named = T.StructField(_CHUNK_KEY, key.dataType)
    numbers = [T.StructField(c, T.IntegerType()) for c in (_CHUNK, _BEFORE)]
    of_chunk = [named, *numbers, T.StructField(_CUTS, positions)]
    return CutPoints(
        spark.createDataFrame(heads, T.StructType([key, T.StructField(_HEADS, positions)])),
        spark.createDataFrame(chunks, T.StructType(of_chunk)),
        max(len(h) for _, h in heads),
        max(len(c) for *_, c in chunks),
    )


def _search(positions: str, most: int) -> Column:
    """How many of the sorted positions lie at or before the row's own, by halving."""
    step_sizes = [1 << bit for bit in reversed(range(most.bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in step_sizes]),
        F.lit(0),
        lambda found, step: F.when(
            F.get(F.col(positions), found + step - 1) <= F.col("_position"), found + step
        ).otherwise(found),
    )


def _with_part(df: DataFrame, timeline: Timeline, cuts: CutPoints) -> DataFrame:
    """Adds each row's part: the number of its key's cut points at or before it.

    Rows without a key are spread by all their values.
    """
    key = F.col(timeline.key)
    values = [
        f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in values]), F.lit(NULL_KEY_PARTS))
    chunk = F.when(F.col(_HEADS).isNotNull(), _search(_HEADS, cuts.most_heads))
    found = (
        df.withColumn("_position", timeline.position(df))
        .join(F.broadcast(cuts.heads), key == F.col(_KEY), "left")
        .withColumn("_in_chunk", chunk)
        .drop(_HEADS)
        .join(
            F.broadcast(cuts.chunks),
            (F.col(_KEY) == F.col(_CHUNK_KEY)) & (F.col("_in_chunk") == F.col(_CHUNK)),
            "left",
        )
    )
    part = (
        F.when(key.isNull(), spread.cast("int"))
        .when(F.col("_in_chunk") == 0, F.lit(0))
        .when(F.col(_CUTS).isNotNull(), F.col(_BEFORE) + _search(_CUTS, cuts.most_cuts))
        .otherwise(F.lit(-1))
    )
    return found.withColumn(_PART, part).drop(
        _KEY, _CHUNK_KEY, _CHUNK, _CUTS, _BEFORE, "_in_chunk", "_position"
    )


def with_parts(
    df: DataFrame, timeline: Timeline, cuts: CutPoints | None
) -> tuple[DataFrame, str | None]:
    """Adds the column that says which part of its key a row is in, if any key is cut."""
    return (df, None) if cuts is None else (_with_part(df, timeline, cuts), _PART)


def _lead_in(
    parts: DataFrame, timeline: Timeline, look_back: int, reads: Sequence[str]
) -> DataFrame:
    """For each part of a cut key, the last ``look_back`` rows before its start."""
    key = F.col(timeline.key)
    rows = list(dict.fromkeys([timeline.key, *timeline.order, *reads]))
    latest_first = Window.partitionBy(timeline.key, _PART).orderBy(
        *[F.col(c).desc_nulls_first() for c in timeline.order]
    )
    # Rank filters are applied before the shuffle as well, so only part ends travel.
    ends = (
        parts.select(*rows, _PART)
        .filter(key.isNotNull() & (F.col(_PART) >= 0))
        .withColumn(_RANK, F.row_number().over(latest_first))
        .filter(F.col(_RANK) <= look_back)
        .drop(_RANK)
    )
    along = timeline.window()
    return (
        ends.withColumn("_new_part", F.lag(_PART).over(along) != F.col(_PART))
        .withColumn(
            "_before",
            F.collect_list(F.struct(*rows)).over(along.rowsBetween(-look_back, -1)),
        )
        .filter("_new_part")
        .select(F.col(_PART), F.inline("_before"))
    )


def over_history(
    df: DataFrame,
    compute: Compute,
    timeline: Timeline,
    look_back: int,
    reads: Sequence[str],
    cuts: CutPoints | None = None,
) -> DataFrame:
    """Runs ``compute(df, window)`` over every key's history.

    Its results may read the columns ``reads`` of at most ``look_back`` earlier rows.
    """
    if cuts is None:
        return compute(df, timeline.window())
    parts = _with_part(df, timeline, cuts)
    lead_in = _lead_in(parts, timeline, look_back, reads)
    every = parts.withColumn(_LEAD, F.lit(False)).unionByName(
        lead_in.withColumn(_LEAD, F.lit(True)), allowMissingColumns=True
    )
    # Said outright, since an input already spread by the key alone would count as
    # clustered by (key, part) and keep all parts of a hot key together.
    every = every.repartition(timeline.key, _PART)
    return compute(every, timeline.window(_PART)).filter(~F.col(_LEAD)).drop(_LEAD, _PART)


def over_prefix(
    df: DataFrame,
    compute: Compute,
    timeline: Timeline,
    totals: Mapping[str, Column],
    fold: Callable[[Column, WindowSpec], Column],
    cuts: CutPoints | None = None,
) -> DataFrame:
    """Runs ``compute(df, window)`` where results depend on all earlier rows of a key.

    ``totals`` names aggregates of a part. In ``compute`` each name is a column with what
    ``fold`` makes of that aggregate over all earlier parts of the key, NULL in the first part;
    so a running sum is that of the window plus the column. What is broadcast has one row per
    part of a cut key. Rows without a key have no history and are folded with none.
    """
    if cuts is None:
        nothing = df.agg(*[c.alias(n) for n, c in totals.items()]).schema
        named = {f.name: F.lit(None).cast(f.dataType) for f in nothing.fields}
        return compute(df.withColumns(named), timeline.window()).drop(*totals)
    key, at = F.col(timeline.key), "_total_part"
    parts = _with_part(df, timeline, cuts)
    sums = (
        parts.filter(key.isNotNull() & (F.col(_PART) >= 0))
        .groupBy(key.alias(_KEY), F.col(_PART).alias(at))
        .agg(*[c.alias(n) for n, c in totals.items()])
    )
    earlier = Window.partitionBy(_KEY).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(_KEY, at, *[fold(F.col(n), earlier).alias(n) for n in totals])
    rows = (
        parts.join(F.broadcast(carried), (key == F.col(_KEY)) & (F.col(_PART) == F.col(at)), "left")
        .drop(_KEY, at)
        .repartition(timeline.key, _PART)
    )
    return compute(rows, timeline.window(_PART)).drop(_PART, *totals)


def with_rank(
    df: DataFrame, timeline: Timeline, out: str, cuts: CutPoints | None = None,
    counted: Column | None = None,
) -> DataFrame:
    """Adds each row's number in its key's history, from 1.

    With ``counted``, the number of rows up to it where that is not NULL instead.
    """
    before, one = "_rows_before", F.lit(1) if counted is None else counted

    def number(rows: DataFrame, w: WindowSpec) -> DataFrame:
        here = F.row_number().over(w).cast("long")
        if counted is not None:
            here = F.count(counted).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn(out, here + F.coalesce(F.col(before), F.lit(0)))

    return over_prefix(
        df, number, timeline, {before: F.count(one)}, lambda c, w: F.sum(c).over(w), cuts
    )


def carried_forward(
    df: DataFrame, value: str, timeline: Timeline, out: str, cuts: CutPoints | None = None
) -> DataFrame:
    """Adds the last value up to each row that is not NULL, over any number of rows and parts."""
    latest = "_last_before"

    def fill(rows: DataFrame, w: WindowSpec) -> DataFrame:
        here = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return rows.withColumn(out, timeline.masked(F.coalesce(here, F.col(latest))))

    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), timeline.position(df)))
    return over_prefix(
        df, fill, timeline, {latest: last}, lambda c, w: F.last(c, ignorenulls=True).over(w), cuts
    )


def key_aggregate(
    df: DataFrame,
    aggregate: Column,
    timeline: Timeline,
    out: str,
    cuts: CutPoints | None = None,
) -> DataFrame:
    """Adds an aggregate over all rows of a key to each of them.

    Cut keys are aggregated on their own, partly before the shuffle, and the result, no
    more rows than there are cut points, is broadcast to their rows, which are not shuffled.
    All other keys take a window.
    """
    if cuts is None:
        whole = Window.partitionBy(timeline.key)
        return df.withColumn(out, timeline.masked(aggregate.over(whole)))
    key = F.col(timeline.key)
    hot = F.broadcast(cuts.heads.select(F.col(_KEY)))
    of_hot = df.join(hot, key == F.col(_KEY), "inner").groupBy(_KEY).agg(aggregate.alias(out))
    without = F.col(_KEY).isNotNull() | key.isNull()
    looked_up = df.join(F.broadcast(of_hot), key == F.col(_KEY), "left").filter(without).drop(_KEY)
    cold = df.filter(key.isNotNull()).join(hot, key == F.col(_KEY), "left_anti")
    whole = Window.partitionBy(timeline.key)
    return cold.withColumn(out, aggregate.over(whole)).unionByName(looked_up)


def first_value(value: str, timeline: Timeline, df: DataFrame) -> Column:
    """Aggregate: ``value`` of a key's earliest row, NULL if it is NULL there."""
    return F.min_by(F.col(value), timeline.position(df))
