"""Linear recurrences along each key's history, also where one key is huge.

``y = a * y' + b`` looks back without bound, but two steps compose to one: ``(a, b)`` after
``(c, d)`` is ``(a * c, a * d + b)``. So every part of a cut key is scanned on its own, the parts'
totals are scanned in turn, and each row applies what it composes to the value its part begins
with. Within a part rows stream through in order, batch by batch, and no history is held whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.history import CutPoints, Timeline, with_parts

_N, _A, _B, _C = "_in_part", "_step_a", "_step_b", "_step_c"


def _scanned(df: DataFrame, steps: int) -> DataFrame:
    """Rows that lie in order, with their steps composed from the row where ``_in_part`` is 1.

    ``_step_a{i}`` and ``_step_b{i}`` say what becomes of a value that comes from before, and
    ``_step_c{i}`` what there is if none does.
    """
    names = [tuple(f"{c}{i}" for c in (_A, _B, _C)) for i in range(steps)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def composed(later, earlier):
            a, b, c = later
            before_a, before_b, before_c = earlier
            none = np.isnan(before_c)
            return a * before_a, a * before_b + b, np.where(none, c, a * before_c + b)

        carried = [(1.0, 0.0, np.nan)] * steps
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.arange(batch.num_rows)
            number = batch.column(_N).to_numpy(zero_copy_only=False)
            begin = np.maximum.accumulate(np.where(number == 1, place, -1))
            back = place - np.maximum(begin, 0)
            goes_on, longest = begin < 0, int(back.max())
            for i, columns in enumerate(names):
                step = [
                    batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns
                ]
                stride = 1
                while stride <= longest:
                    at = np.flatnonzero(back >= stride)
                    made = composed([x[at] for x in step], [x[at - stride] for x in step])
                    for x, value in zip(step, made):
                        x[at] = value
                    stride *= 2
                made = composed([x[goes_on] for x in step], carried[i])
                for x, value in zip(step, made):
                    x[goes_on] = value
                carried[i] = tuple(x[-1] for x in step)
                for name, values in zip(columns, step):
                    at = batch.schema.get_field_index(name)
                    batch = batch.set_column(at, name, pa.array(values, from_pandas=True))
            yield batch

    return df.mapInArrow(scan, df.schema)


def linear_scan(
    df: DataFrame,
    steps: Mapping[str, tuple[Column, ...]],
    timeline: Timeline,
    cuts: CutPoints | None = None,
) -> DataFrame:
    """Adds ``y = a * y' + b`` for each name in ``steps``, y' being the value of the row before.

    A step is (a, b) or (a, b, start): with a start, that is the value of the first row that has
    a step, and rows before it have NULL; without one, y' is 0 there. Where a or b is NULL the
    value is passed on as it is. All names share one pass over the rows. Rows without a key get
    NULL.
    """
    columns = {}
    for i, (a, b, *start) in enumerate(steps.values()):
        known = a.isNotNull() & b.isNotNull()
        first = start[0] if start else b
        columns[f"{_A}{i}"] = F.when(known, a.cast("double")).otherwise(F.lit(1.0))
        columns[f"{_B}{i}"] = F.when(known, b.cast("double")).otherwise(F.lit(0.0))
        none = F.lit(None).cast("double") if start else F.lit(0.0)
        columns[f"{_C}{i}"] = F.when(known, first.cast("double")).otherwise(none)
    rows, part = with_parts(df, timeline, cuts)
    # Numbering the rows leaves them as the scan needs them: a part in one task, in order.
    if part is None:
        rows = rows.withColumns(columns | {_N: F.row_number().over(timeline.window())})
    else:
        rows = rows.repartition(timeline.key, part)
        rows = rows.withColumns(columns | {_N: F.row_number().over(timeline.window(part))})
    rows = _scanned(rows, len(steps))
    outs = {name: F.col(f"{_C}{i}") for i, name in enumerate(steps)}
    if part is not None:
        before = _totals(rows, timeline, part, len(steps))
        key = F.col(timeline.key)
        rows = rows.join(
            F.broadcast(before), (key == F.col("_of_key")) & (F.col(part) == F.col("_of_part")), "left"
        )
        outs = {
            name: F.when(F.col(f"_before{i}").isNull(), c).otherwise(
                F.col(f"{_A}{i}") * F.col(f"_before{i}") + F.col(f"{_B}{i}")
            )
            for i, (name, c) in enumerate(outs.items())
        }
    masked = {name: timeline.masked(c) for name, c in outs.items()}
    return rows.withColumns(masked).select(*[c for c in df.columns if c not in outs], *outs)


def _totals(rows: DataFrame, timeline: Timeline, part: str, steps: int) -> DataFrame:
    """For each part of a cut key the values its earlier parts end with; as many rows as cuts."""
    values = [f"{s}{i}" for i in range(steps) for s in (_A, _B, _C)]
    ends = (
        rows.filter(F.col(timeline.key).isNotNull() & (F.col(part) >= 0))
        .groupBy(F.col(timeline.key).alias("_of_key"), F.col(part).alias("_of_part"))
        .agg(F.max_by(F.struct(*values), F.col(_N)).alias("_end"))
        .select("_of_key", "_of_part", "_end.*")
    )
    along = Window.partitionBy("_of_key").orderBy("_of_part")
    ends = _scanned(ends.withColumn(_N, F.row_number().over(along)), steps)
    return ends.select(
        "_of_key", "_of_part",
        *[F.lag(f"{_C}{i}").over(along).alias(f"_before{i}") for i in range(steps)],
    )
