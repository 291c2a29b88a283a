"""Gold features and rebased values kept per key in a state store.

The state of a key is its newest rows: those no older than ``lateness`` before its newest
one, and as many rows before them as features look back. A micro-batch touches the state of the
keys it has rows for, and no other. A row that comes after later ones changes the features of at
most six rows behind it; these leave the operator again, and readers take the newest of each. A
row that comes later than ``lateness`` cannot be placed any more and leaves it marked, without
features; rebuilding Gold takes it in.

The operator gets what it reads of a row and the row as one text, and gives that text with what it
has made: each column that passes a Python process costs time, for every row in and every key out.

Lateness is counted per key, against its own newest row, when rows come. Timers would need a
watermark, and Spark drops rows behind that before the operator sees them; on the clock they keep
a stream that takes what is there and stops from ever stopping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemark.operators.history import Timeline
from tidemark.plans.jobs import Layers
from tidemark.plans.layers import GOLD_LOOK_BACK
from tidemark.session import ship
from tidemark.sources import tables
from tidemark.sources.schemas import GOLD_FEATURES, SILVER, with_batch

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

REBASED, TOO_LATE = "rebased", "too_late"
_WHOLE, _MADE = "_whole", "_made"
LIVE = T.StructType([
    *SILVER.fields, *[T.StructField(c, T.DoubleType()) for c in (*GOLD_FEATURES, REBASED)],
    T.StructField(TOO_LATE, T.BooleanType()),
])


def _encoded(df: DataFrame) -> DataFrame:
    """Times as microseconds and dates as days, which Python takes without a time zone."""
    def plain(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.unix_micros(c).alias(f.name)
        return F.unix_date(c).alias(f.name) if isinstance(f.dataType, T.DateType) else c

    return df.select(*[plain(f) for f in df.schema.fields])


def _decoded(df: DataFrame, schema: T.StructType) -> DataFrame:
    def typed(f: T.StructField) -> Column:
        c = F.col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = F.timestamp_micros(c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_from_unix_date(c)
        return c.cast(f.dataType).alias(f.name)

    return df.select(*[typed(f) for f in schema.fields])


def features(rows: list, at: int, time: int, value: int, share: int | None) -> list:
    """The gold columns of ``rows[at]``, in their order, by the rules of ``plans.layers``."""
    import math

    def change(i: int) -> float | None:
        if i < 1 or rows[i][value] is None or not rows[i - 1][value]:
            return None
        return (rows[i][value] / rows[i - 1][value] - 1) * 100

    def log(i: int) -> float | None:
        pct = change(i)
        return math.log(1 + pct / 100) if pct is not None and 1 + pct / 100 > 0 else None

    def mean(n: int) -> float | None:
        found = [r[value] for r in rows[max(0, at - n + 1) : at + 1] if r[value] is not None]
        return sum(found) / len(found) if found else None

    logs = [x for x in map(log, range(max(0, at - 2), at + 1)) if x is not None]
    spread = None
    if len(logs) > 1:
        middle = sum(logs) / len(logs)
        spread = math.sqrt(sum((x - middle) ** 2 for x in logs) / (len(logs) - 1))
    now, before = rows[at], rows[at - 1] if at else None
    minutes = shift = None
    if before is not None and now[time] is not None and before[time] is not None:
        minutes = (now[time] - before[time]) / 60e6
    if share is not None and before is not None:
        if now[share] is not None and before[share] is not None:
            shift = now[share] - before[share]
    return [change(at), minutes, log(at), mean(3), mean(7), spread, shift]


class _Features(StatefulProcessor):
    """Gives the last column of each row, which stands for the row, and what was made for it."""

    def __init__(
        self, schema: T.StructType, timeline: Timeline, value: str, share: str | None,
        flag: str | None, lateness_ms: int,
    ) -> None:
        names = schema.names
        self.schema = schema
        self.order = [names.index(c) for c in timeline.order]
        self.time, self.value = names.index(timeline.time), names.index(value)
        self.share = None if share is None else names.index(share)
        self.flag = None if flag is None else names.index(flag)
        self.lateness = lateness_ms
        self.out = Row(_WHOLE, _MADE, TOO_LATE)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", self.schema)
        # Whether older rows have left the state, and the first value that is not flagged.
        self.known = handle.getValueState("known", "cut boolean, based boolean, base double")

    def _place(self, row) -> tuple:
        return tuple((row[i] is None, 0 if row[i] is None else row[i]) for i in self.order)

    def _horizon(self, rows: list) -> int:
        """How many of the oldest rows no late row may come before any more."""
        times = [r[self.time] for r in rows if r[self.time] is not None]
        if not times:
            return 0
        first = max(times) - self.lateness * 1000
        return sum(1 for r in rows if r[self.time] is not None and r[self.time] < first)

    def handleInputRows(self, key, rows, timerValues):
        # Every call of a state is a message to another process and back.
        stored = tuple(self.known.get() or ())
        cut, based, base = stored or (False, False, None)
        held = {self._place(r): tuple(r) for r in self.recent.get()} if stored else {}
        oldest = min(held) if held else None
        fresh, late = set(), []
        for row in rows:
            place = self._place(row)
            # Rows that have left the state stand before all that are in it.
            if cut and oldest is not None and place < oldest:
                late.append(tuple(row))
            else:
                held[place] = tuple(row)
                fresh.add(place)
        places = sorted(held)
        history = [held[p] for p in places]
        if cut:
            # The oldest rows are there to be looked back on; nothing may come among them.
            blocked = [i for i in range(min(GOLD_LOOK_BACK, len(places))) if places[i] in fresh]
            late += [history[i] for i in blocked]
            keep = [i for i in range(len(places)) if i not in blocked]
            fresh -= {places[i] for i in blocked}
            places, history = [places[i] for i in keep], [history[i] for i in keep]
        before = (based, base)
        if not cut or not based:
            plain = [r for r in history if self.flag is None or not r[self.flag]]
            based, base = (True, plain[0][self.value]) if plain else (False, None)
        moved = (based, base) != before
        touched = set()
        for i, place in enumerate(places):
            if place in fresh:
                touched.update(range(i, min(i + GOLD_LOOK_BACK + 1, len(places))))
        if moved:
            touched.update(range(GOLD_LOOK_BACK if cut else 0, len(places)))
        for i in sorted(touched):
            row = history[i]
            flagged = self.flag is not None and row[self.flag]
            known = based and not flagged and row[self.value] is not None and base
            value = row[self.value] / base * 100 if known else None
            made = features(history, i, self.time, self.value, self.share)
            yield self.out(row[-1], [*made, value], False)
        for row in late:
            yield self.out(row[-1], None, True)
        drop = max(0, self._horizon(history) - GOLD_LOOK_BACK)
        if history:
            self.recent.put(history[drop:])
        known = (bool(cut or drop), bool(based), base)
        if known != stored:
            self.known.update(known)

    def close(self) -> None:
        pass


def with_live_features(
    silver: DataFrame,
    timeline: Timeline = Timeline(),
    value: str = "quote_USD_price",
    share: str | None = "quote_USD_market_cap_dominance",
    flag: str | None = "is_stablecoin",
    lateness_ms: int = 86_400_000,
) -> DataFrame:
    """Rows of a stream with gold features, ``rebased`` (null where flagged) and ``too_late``.

    A row leaves once when it comes and again whenever a late row or an earlier first value
    changes it. Rows without a key have no history and pass without features. A key's new rows
    of one micro-batch meet in one task; the trigger's size bounds them.
    """
    ship(silver.sparkSession)
    plain = _encoded(silver)
    extra = [T.StructField(c, T.DoubleType()) for c in (*GOLD_FEATURES, REBASED)]
    extra.append(T.StructField(TOO_LATE, T.BooleanType()))
    reads = dict.fromkeys(c for c in (timeline.key, *timeline.order, value, share, flag) if c)
    packed = plain.select(*reads, F.to_json(F.struct("*")).alias(_WHOLE))
    keyed = (
        packed.filter(F.col(timeline.key).isNotNull())
        .groupBy(timeline.key)
        .transformWithState(
            _Features(packed.schema, timeline, value, share, flag, lateness_ms),
            f"{_WHOLE} string, {_MADE} array<double>, {TOO_LATE} boolean", "Update", "None",
        )
        .withColumn(_WHOLE, F.from_json(_WHOLE, plain.schema))
        .select(
            f"{_WHOLE}.*", *[F.get(_MADE, F.lit(i)).alias(f.name) for i, f in enumerate(extra[:-1])],
            TOO_LATE,
        )
    )
    nothing = [F.lit(None).cast("double").alias(f.name) for f in extra[:-1]]
    unkeyed = plain.filter(F.col(timeline.key).isNull()).select(
        "*", *nothing, F.lit(False).alias(TOO_LATE)
    )
    schema = T.StructType([*silver.schema.fields, *extra])
    return _decoded(keyed.unionByName(unkeyed), schema)


def stateful_gold_stream(
    spark: SparkSession,
    layers: Layers,
    lateness_ms: int = 86_400_000,
    every: str | None = None,
    files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Silver's files to ``layers.stateful_gold``, batch by batch.

    It reads the folders of Silver's batches, so it has to keep up with their compaction. The
    session's own state store is not changed: the stream runs in a session beside it.
    """
    beside = spark.newSession()
    beside.conf.set(PROVIDER, STORE)
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        beside.conf.set(name, spark.conf.get(name))
    tables.create_batches(spark, layers.silver, SILVER)
    reader = beside.readStream.schema(with_batch(SILVER))
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    silver = reader.parquet(layers.silver).select(*SILVER.names)
    live = with_live_features(silver, lateness_ms=lateness_ms)

    def write(rows: DataFrame, batch: int) -> None:
        label = f"stream-{batch:012d}"
        folder = layers.commits("stateful_gold")
        if not tables.is_committed(spark, folder, label):
            tables.write_batch(rows, layers.stateful_gold, label)
            tables.commit(spark, folder, label)

    query = live.writeStream.foreachBatch(write).outputMode("update").option(
        "checkpointLocation", layers.checkpoint("stateful_gold")
    )
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return query.trigger(**trigger).start()


def read_stateful_gold(
    spark: SparkSession, layers: Layers, timeline: Timeline = Timeline()
) -> DataFrame:
    """The newest form of every row of the complete batches; ``too_late`` rows are among them."""
    tables.create_batches(spark, layers.stateful_gold, LIVE)
    complete = tables.read_commits(spark, layers.commits("stateful_gold")).select("batch_id")
    rows = tables.read_batches(spark, layers.stateful_gold, LIVE)
    rows = rows.join(F.broadcast(complete), "batch_id", "left_semi")
    newest = Window.partitionBy(timeline.key, *timeline.order).orderBy(F.desc("batch_id"))
    keyed = (
        rows.filter(F.col(timeline.key).isNotNull())
        .withColumn("_form", F.row_number().over(newest))
        .filter("_form = 1")
        .select(*LIVE.names)
    )
    return keyed.unionByName(rows.filter(F.col(timeline.key).isNull()).select(*LIVE.names))
