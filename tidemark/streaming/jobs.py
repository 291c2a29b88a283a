"""Landing to Bronze, Bronze to Silver, Silver to live Gold as checkpointed streams.

Each query hands its micro-batches to the same transforms the batch jobs use, and
writes every micro-batch to its own directory. When that is complete it leaves a commit
record; the next stream reads those records, not the directories. A micro-batch that is
retried before its record is written replaces itself, one that is retried later does nothing,
and either way the next stream takes it once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.dedup import first_arrivals
from tidemark.operators.history import (
    ROWS_PER_PART, Timeline, find_cut_points, key_aggregate, over_history,
)
from tidemark.plans.jobs import Layers, write_bronze, write_silver
from tidemark.plans.layers import GOLD_LOOK_BACK, add_features, to_gold
from tidemark.sources import files, tables
from tidemark.sources.landing import stream_payloads, with_place
from tidemark.sources.schemas import BRONZE, COIN, GOLD, SILVER, STATUS

# Buckets of keys in the state of live Gold. A state keeps the number it began with.
BUCKETS = 256
# How far before the first late row its predecessors are looked for at first.
LATE_DAYS = 7
_CARRIED, _LAST, _LATE, _NEW = "_carried", "_last_time", "_late", "_new"
_FIRST, _CHANGED, _BUCKET = "_first_late", "_changed", "bucket"


def _label(batch: int) -> str:
    return f"stream-{batch:012d}"


def _start(df: DataFrame, write, checkpoint: str, every: str | None) -> StreamingQuery:
    query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return query.trigger(**trigger).start()


def bronze_stream(
    spark: SparkSession,
    landing: str,
    layers: Layers,
    endpoint: str,
    every: str | None = None,
    multi_line: bool = True,
    files_per_batch: int | None = None,
    coin: T.StructType = COIN,
    status: T.StructType = STATUS,
) -> StreamingQuery:
    """Landing files to Bronze and audit. ``every`` is a polling interval such as
    ``"4 hours"``; without one the query takes what is there and stops."""

    def write(payloads: DataFrame, batch: int) -> None:
        if not tables.is_committed(spark, layers.commits("bronze"), _label(batch)):
            write_bronze(with_place(payloads), layers, _label(batch), endpoint, coin, status)

    payloads = stream_payloads(spark, landing, multi_line, files_per_batch)
    return _start(payloads, write, layers.checkpoint("bronze"), every)


def _taken(commits: DataFrame) -> list[str]:
    # One short name per batch of the layer above since the last trigger.
    return sorted({row["batch_id"] for row in commits.select("batch_id").collect()})


def silver_stream(
    spark: SparkSession,
    layers: Layers,
    mode: str = "quarantine",
    every: str | None = None,
    batches_per_trigger: int | None = None,
    max_rank: int | None = None,
) -> StreamingQuery:
    """Bronze to Silver, batch by batch as they become complete. Replayed rows are matched
    against the stored rows of their times, so they add nothing however late they come."""

    def write(commits: DataFrame, batch: int) -> None:
        advance_silver(spark, layers, batch, _taken(commits), mode, max_rank)

    commits = tables.stream_commits(spark, layers.commits("bronze"), batches_per_trigger)
    return _start(commits, write, layers.checkpoint("silver"), every)


def advance_silver(
    spark: SparkSession, layers: Layers, batch: int, taken: list[str], mode: str = "quarantine",
    max_rank: int | None = None,
) -> None:
    """One micro-batch of Silver; nothing if it is complete already."""
    if tables.is_committed(spark, layers.commits("silver"), _label(batch)):
        return
    bronze = layers.read_batches(spark, "bronze", BRONZE, taken)
    write_silver(bronze, layers, _label(batch), mode, max_rank)


def gold_stream(
    spark: SparkSession,
    layers: Layers,
    timeline: Timeline = Timeline(),
    every: str | None = None,
    batches_per_trigger: int | None = None,
    rows_per_part: int = ROWS_PER_PART,
) -> StreamingQuery:
    """Silver to live Gold, adding the features of each new row.

    A key's features need its last few rows only; these are kept between batches, in buckets
    of keys, so a batch costs its own keys and rows, not the history. A row no later than its
    key's last one changes features already written: it is noted in the late table, and the
    rows that look back on it are computed anew from Silver and take the place of the old ones.
    """

    def write(commits: DataFrame, batch: int) -> None:
        taken = _taken(commits)
        silver = layers.read_batches(spark, "silver", SILVER, taken).drop("batch_id")
        advance_gold(silver, layers, batch, timeline, rows_per_part, taken)

    commits = tables.stream_commits(spark, layers.commits("silver"), batches_per_trigger)
    return _start(commits, write, layers.checkpoint("gold"), every)


def distinct_stream(
    rows: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: Sequence[str],
    time: str, lateness: str, every: str | None = None,
) -> StreamingQuery:
    """The first arrivals of a stream as Parquet files below ``path``, each key once.

    See ``dedup.first_arrivals``; the file sink writes every micro-batch once, retried or not.
    """
    kept = first_arrivals(rows, keys, order, time, lateness)
    query = kept.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return query.trigger(**trigger).start(path)


def start_all(
    spark: SparkSession,
    landing: str,
    layers: Layers,
    endpoint: str,
    every: str,
    mode: str = "quarantine",
    multi_line: bool = True,
    max_rank: int | None = None,
    coin: T.StructType = COIN,
    status: T.StructType = STATUS,
) -> list[StreamingQuery]:
    """All three streams, each looking for new work at the interval ``every``."""
    return [
        bronze_stream(spark, landing, layers, endpoint, every, multi_line, None, coin, status),
        silver_stream(spark, layers, mode, every, max_rank=max_rank),
        gold_stream(spark, layers, every=every),
    ]


def advance_gold(
    silver: DataFrame, layers: Layers, batch: int, timeline: Timeline, rows_per_part: int,
    taken: Sequence[str] = (), buckets: int = BUCKETS,
) -> None:
    """One micro-batch of live Gold; nothing if it is complete already.

    The state lies in buckets of keys. A batch reads and writes the buckets of its own keys and
    notes for all of them which batch wrote them last; what that note and the one before it
    name stays, so a batch can be run again. ``taken`` are the Silver batches that ``silver`` is.
    """
    spark = silver.sparkSession
    if tables.is_committed(spark, layers.commits("gold"), _label(batch)):
        return
    silver = silver.select(*SILVER.names)
    before = _state_map(spark, layers, batch - 1)
    bucket = F.pmod(F.xxhash64(timeline.key), F.lit(buckets)).cast("int").alias(_BUCKET)
    keyed = silver.filter(F.col(timeline.key).isNotNull())
    # At most as many numbers as there are buckets.
    touched = sorted(row[0] for row in keyed.select(bucket).distinct().collect())
    carried = _carried_rows(spark, layers, {b: before[b] for b in touched if b in before})
    history = silver.withColumn(_CARRIED, F.lit(False)).unionByName(
        carried.withColumn(_CARRIED, F.lit(True))
    )
    cuts = find_cut_points(history, timeline, rows_per_part)
    last = F.max(F.when(F.col(_CARRIED), F.col(timeline.time)))
    is_late = ~F.col(_CARRIED) & F.coalesce(F.col(timeline.time) <= F.col(_LAST), F.lit(False))
    # The jobs below read the batch; Spark rebuilds lost pieces of it from its files.
    marked = (
        key_aggregate(history, last, timeline, _LAST, cuts)
        .withColumn(_LATE, is_late)
        .select(*SILVER.names, _CARRIED, _LATE)
        .persist()
    )
    try:
        order = [timeline.key, *timeline.order]
        late = marked.filter(_LATE).drop(_LATE, _CARRIED)
        new = ~F.col(_CARRIED) & ~F.col(_LATE) if taken else ~F.col(_CARRIED)
        some_late, some_new = marked.agg(
            F.coalesce(F.bool_or(_LATE), F.lit(False)), F.coalesce(F.bool_or(new), F.lit(False))
        ).first()
        # Carried rows are the newest of their keys, so rows after them find all they look back on.
        gold = to_gold(marked, timeline, cuts=cuts).filter(new).select(*GOLD.names)
        if not some_new:
            gold = tables.no_rows(spark, GOLD)
        if some_late:
            tables.write_batch(late, layers.late, _label(batch))
        if some_late and taken:
            again = _changed_by_late(late, layers, timeline, rows_per_part, taken)
            gold = gold.unionByName(again.select(*GOLD.names))
            earlier = again.filter(~F.col(_LATE)).select(*order)
            earlier.write.mode("overwrite").parquet(f"{layers.folded}/batch_id={_label(batch)}")
        span = [F.min(tables.DATE).alias("first"), F.max(tables.DATE).alias("last")]
        written = tables.write_batch(gold, layers.live_gold, _label(batch), order, span)
        tables.note_rows(spark, layers.rows("live_gold"), _label(batch), **written)
        state = _newest(marked.drop(_CARRIED, _LATE), timeline).select(*SILVER.names, bucket)
        state.repartition(_BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(
            f"{layers.live_state}/batch_id={_label(batch)}"
        )
        now = before | {b: _label(batch) for b in touched}
        files.write_text(spark, _map_path(layers, batch), json.dumps(now))
        tables.commit(spark, layers.commits("gold"), _label(batch), taken)
        _drop_state(spark, layers, batch, (before, now))
    finally:
        marked.unpersist()


def _map_path(layers: Layers, batch: int) -> str:
    return f"{layers.live_state}/map-{max(batch, 0):012d}.json"


def _state_map(spark: SparkSession, layers: Layers, batch: int) -> dict[int, str]:
    """Which batch wrote each bucket last, as of ``batch``."""
    text = files.read_text(spark, _map_path(layers, batch)) if batch >= 0 else None
    return {int(bucket): label for bucket, label in json.loads(text).items()} if text else {}


def _carried_rows(spark: SparkSession, layers: Layers, held: dict[int, str]) -> DataFrame:
    base = layers.live_state
    paths = [f"{base}/batch_id={label}/{_BUCKET}={b}" for b, label in sorted(held.items())]
    if not paths:
        return tables.no_rows(spark, SILVER)
    return spark.read.schema(SILVER).parquet(*paths)


def _drop_state(
    spark: SparkSession, layers: Layers, batch: int, kept: tuple[dict[int, str], ...]
) -> None:
    """Deletes the buckets that neither this batch's note nor the one before it names."""
    held = {(label, b) for note in kept for b, label in note.items()}
    for b, label in _state_map(spark, layers, batch - 2).items():
        if (label, b) not in held:
            files.delete(spark, f"{layers.live_state}/batch_id={label}/{_BUCKET}={b}")
    if batch >= 2:
        files.delete(spark, _map_path(layers, batch - 2))


def _changed_by_late(
    late: DataFrame, layers: Layers, timeline: Timeline, rows_per_part: int, taken: Sequence[str]
) -> DataFrame:
    """The late rows and the rows that look back on them, with their features.

    Only the dates from ``LATE_DAYS`` before the first late row are read, unless some key has
    fewer rows there than features look back on; then all dates are. Rows of this batch that are
    not late have their features already.
    """
    spark = late.sparkSession
    done = tables.read_commits(spark, layers.commits("gold"))
    now = spark.createDataFrame([(b,) for b in taken], "batch_id STRING")
    done = done.select(F.explode("took").alias("batch_id")).unionByName(now)
    keys = late.groupBy(timeline.key).agg(F.min(timeline.time).alias(_FIRST))
    # One row per key of this batch that has late rows.
    stored = (
        layers.read_batches(spark, "silver", SILVER)
        .join(F.broadcast(done), "batch_id", "left_semi")
        .join(keys, timeline.key)
    )
    day = late.agg(F.min(F.to_date(timeline.time))).first()[0]
    recent = stored.filter(F.col(tables.DATE) >= F.lit(day) - F.expr(f"INTERVAL {LATE_DAYS} DAYS"))
    before = F.count_if(F.col(timeline.time) < F.col(_FIRST)).alias("n")
    short = recent.groupBy(timeline.key).agg(before).filter(F.col("n") < GOLD_LOOK_BACK)
    rows = stored if not short.isEmpty() else recent
    marks = late.select(timeline.key, *timeline.order, F.lit(True).alias(_LATE))
    new = F.col("batch_id").isin(*taken)
    rows = (
        rows.join(marks, [timeline.key, *timeline.order], "left")
        .withColumns({_LATE: F.coalesce(_LATE, F.lit(False)), _NEW: new})
        .drop(_FIRST, "batch_id")
    )
    cuts = find_cut_points(rows, timeline, rows_per_part)

    def near(df: DataFrame, w: WindowSpec) -> DataFrame:
        behind = F.max(_LATE).over(w.rowsBetween(-GOLD_LOOK_BACK, 0))
        return add_features(df, w, timeline).withColumn(_CHANGED, behind)

    reads = ["quote_USD_price", "quote_USD_market_cap_dominance", _LATE]
    featured = over_history(rows, near, timeline, GOLD_LOOK_BACK, reads, cuts)
    return featured.filter(F.col(_CHANGED) & (F.col(_LATE) | ~F.col(_NEW)))


def _newest(history: DataFrame, timeline: Timeline) -> DataFrame:
    """The rows of each key that later features will read, and one more."""
    latest_first = Window.partitionBy(timeline.key).orderBy(
        *[F.col(c).desc_nulls_first() for c in timeline.order]
    )
    return (
        history.filter(F.col(timeline.key).isNotNull())
        .withColumn("_newest", F.row_number().over(latest_first))
        .filter(F.col("_newest") <= GOLD_LOOK_BACK + 1)
        .drop("_newest")
    )


def read_live_gold(
    spark: SparkSession, layers: Layers, timeline: Timeline = Timeline()
) -> DataFrame:
    """Live Gold as of its complete batches; of a row that late ones changed, its newest form."""
    tables.create_batches(spark, layers.live_gold, GOLD)
    complete = F.broadcast(tables.read_commits(spark, layers.commits("gold")).select("batch_id"))
    rows = layers.read_batches(spark, "live_gold", GOLD).join(complete, "batch_id", "left_semi")
    if not files.names(spark, layers.folded):
        return rows.select(*GOLD.names)
    at = [timeline.key, *timeline.order]
    schema = T.StructType([*[SILVER[c] for c in at], T.StructField("batch_id", T.StringType())])
    again = tables.read_layer(spark, layers.folded, schema).join(complete, "batch_id", "left_semi")
    since = again.groupBy(*at).agg(F.max("batch_id").alias("_since"))
    valid = F.col("_since").isNull() | (F.col("batch_id") >= F.col("_since"))
    return rows.join(since, at, "left").filter(valid).select(*GOLD.names)


def read_late(spark: SparkSession, layers: Layers) -> DataFrame:
    tables.create_batches(spark, layers.late, SILVER)
    return tables.read_batches(spark, layers.late, SILVER).drop("batch_id")


def latest_date(spark: SparkSession, layers: Layers) -> date | None:
    """The last date of ``latest_gold``, from the notes of its batches or the names of folders."""
    if files.names(spark, layers.commits("gold")):
        last = tables.row_notes(spark, layers.rows("live_gold")).agg(F.max("last")).first()[0]
        return date.fromisoformat(last) if last else None
    version = tables.current_version(spark, layers.gold)
    return None if version is None else tables.last_date(spark, version)


def latest_gold(spark: SparkSession, layers: Layers) -> DataFrame:
    """Live Gold where the streams have written some, else the Gold that was rebuilt."""
    if files.names(spark, layers.commits("gold")):
        return read_live_gold(spark, layers)
    return layers.read_gold(spark)
