"""Batch jobs over the stored layers.

A batch that is run again under its id replaces itself. Bronze keeps whatever lands, also
twice under two ids; Silver adds only keys it does not have, and Gold follows Silver.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import reports
from tidemark.operators.history import ROWS_PER_PART, Timeline, find_cut_points
from tidemark.operators.quality import (
    Check, QualityError, check_report, failing_counters, gate, null_counters, snapshot_checks, split_rows,
)
from tidemark.plans.layers import (
    clean, date_of, parsed, silver_increment, to_audit, to_bronze, to_gold,
)
from tidemark.sources import files, tables
from tidemark.sources.files import checked_name
from tidemark.sources.landing import read_payloads
from tidemark.sources.schemas import (
    AUDIT, BRONZE, COIN, GOLD, SILVER, SILVER_KEY, STATUS, further_fields, with_more,
)

MODES = ("fail", "quarantine", "report")


@dataclass(frozen=True)
class Layers:
    """Paths of the stored tables below one root on shared storage."""

    root: str

    def _at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def bronze(self) -> str:
        return self._at("bronze")

    @property
    def audit(self) -> str:
        return self._at("audit")

    @property
    def silver(self) -> str:
        return self._at("silver")

    @property
    def quarantine(self) -> str:
        return self._at("quarantine")

    @property
    def gold(self) -> str:
        return self._at("gold")

    @property
    def live_gold(self) -> str:
        return self._at("live_gold")

    @property
    def stateful_gold(self) -> str:
        return self._at("stateful_gold")

    @property
    def late(self) -> str:
        return self._at("late")

    @property
    def folded(self) -> str:
        return self._at("folded")

    @property
    def live_state(self) -> str:
        """The newest rows of every key, by the batch that wrote them and bucket of keys."""
        return self._at("live_state")

    def checkpoint(self, stream: str) -> str:
        return self._at(f"checkpoints/{stream}")

    def commits(self, layer: str) -> str:
        """Records of the layer's complete batches."""
        return self._at(f"commits/{layer}")

    def staging(self, layer: str, batch_id: str) -> str:
        return self._at(f"staging/{layer}/{checked_name(batch_id)}")

    def base(self, layer: str) -> str:
        """The runs that batches of a layer have been merged into."""
        return self._at(f"{layer}_base")

    def rows(self, layer: str) -> str:
        """Notes of the rows of each batch."""
        return self._at(f"rows/{layer}")

    def read_bronze(self, spark: SparkSession, more: T.StructType | None = None) -> DataFrame:
        """``more`` names fields that a wider ``coin`` schema has added."""
        return self.read_batches(spark, "bronze", with_more(BRONZE, more))

    def read_audit(self, spark: SparkSession, more: T.StructType | None = None) -> DataFrame:
        return self.read_batches(spark, "audit", with_more(AUDIT, more))

    def read_silver(self, spark: SparkSession, more: T.StructType | None = None) -> DataFrame:
        return self.read_batches(spark, "silver", with_more(SILVER, more)).drop("batch_id")

    def read_batches(
        self, spark: SparkSession, layer: str, schema: T.StructType,
        batch_ids: Iterable[str] | None = None,
    ) -> DataFrame:
        """A layer with the batch of every row, from its runs and the batches since.

        ``batch_ids`` names those wanted, if not all; folders of others are not listed.
        """
        path, base = self._at(layer), self.base(layer)
        found, held = tables.runs(spark, base)
        if batch_ids is None:
            since = tables.read_batches(spark, path, schema)
            merged = [b for b in tables.batch_ids(spark, path) if b in held]
            if merged:
                since = since.filter(~F.col("batch_id").isin(sorted(merged)))
            return since.unionByName(tables.read_runs(spark, base, found, schema)) if found else since
        wanted = sorted(set(batch_ids))
        old = [b for b in wanted if b in held]
        since = tables.read_some(spark, path, schema, [b for b in wanted if b not in held])
        if not old:
            return since
        rows = tables.read_runs(spark, base, found, schema)
        return since.unionByName(rows.filter(F.col("batch_id").isin(old)))

    def read(self, spark: SparkSession, layer: str) -> DataFrame:
        """Any of bronze, audit, silver and gold."""
        return getattr(self, f"read_{layer}")(spark)

    def read_gold(self, spark: SparkSession, more: T.StructType | None = None) -> DataFrame:
        return tables.read_current(spark, self.gold, with_more(GOLD, more))

    def read_notes(self, spark: SparkSession, table: str) -> DataFrame:
        """What building Silver has noted: checks, counts or nulls, by batch."""
        schema = T.StructType.fromDDL(f"{NOTES[table]}, batch_id STRING")
        return tables.read_layer(spark, self.notes(table), schema)

    def notes(self, table: str) -> str:
        return self._at(f"silver_{table}")


NOTES = {
    "checks": "`check` STRING, passed BOOLEAN, failing_rows BIGINT",
    "counts": "rows_before BIGINT, set_apart BIGINT, removed BIGINT, rows_after BIGINT",
    "nulls": "`column` STRING, nulls BIGINT, pct DOUBLE",
    "summary": "rows BIGINT, keys BINARY, snapshots BINARY, first_time TIMESTAMP, "
    "last_time TIMESTAMP",
}


def write_bronze(
    payloads: DataFrame,
    layers: Layers,
    batch_id: str,
    endpoint: str,
    coin: T.StructType = COIN,
    status: T.StructType = STATUS,
) -> None:
    """Appends the batch's listings, then one audit row per payload.

    The payloads are parsed once, into a table that both are taken from. ``coin`` and
    ``status`` may be wider than the declared schemas; their further fields become columns.
    """
    spark = payloads.sparkSession
    _not_held(spark, layers, "bronze", batch_id)
    staging = layers.staging("bronze", batch_id)
    rows = parsed(payloads, coin, status)
    rows.write.mode("overwrite").parquet(staging)
    rows = spark.read.schema(rows.schema).parquet(staging)
    for layer, df in (("bronze", to_bronze(rows)), ("audit", to_audit(rows, endpoint))):
        # Audit rows repeat their file's name and time, and many may share one date.
        written = tables.write_batch(
            df, getattr(layers, layer), batch_id, dense=layer == "audit")
        tables.note_rows(spark, layers.rows(layer), batch_id, written["rows"])
    files.delete(spark, staging)
    tables.commit(spark, layers.commits("bronze"), batch_id)


def _not_held(spark: SparkSession, layers: Layers, layer: str, batch_id: str) -> None:
    if batch_id in tables.runs(spark, layers.base(layer))[1]:
        raise ValueError(f"batch {batch_id!r} is part of the compacted {layer}")


def import_bronze(spark: SparkSession, paths: list[str], layers: Layers, batch_id: str) -> None:
    """Appends listings kept as CSV so far; a path holds files of one column layout.

    Rows that were exported from Bronze keep their origin; others come in file order.
    """
    _not_held(spark, layers, "bronze", batch_id)
    rows = tables.import_csv(spark, paths, BRONZE)
    rows = rows.withColumn(tables.DATE, date_of("collected_at"))
    written = tables.write_batch(rows, layers.bronze, batch_id)
    tables.note_rows(spark, layers.rows("bronze"), batch_id, written["rows"])
    tables.commit(spark, layers.commits("bronze"), batch_id)


def _counted(cleaned: DataFrame, checks: list[Check]) -> dict:
    """Rows, failing rows, and the stretch of time they span, in one pass over the checked
    columns."""
    time = F.col("collected_at")
    return cleaned.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(time.cast("timestamp_ntz")).alias("first"),
        F.max(time.cast("timestamp_ntz")).alias("last"),
        F.count_if(time.isNull()).alias("without_time"),
        *failing_counters(checks),
    ).first().asDict()


def _same_times(stored: DataFrame, seen: dict) -> DataFrame:
    """Stored rows of the stretch of time that the new ones span; other dates are not read."""
    time, day, kept = F.col("collected_at"), F.col(tables.DATE), F.lit(False)
    if seen["first"] is not None:
        low, high = (F.lit(seen[c]).cast("timestamp") for c in ("first", "last"))
        kept = (day >= F.lit(seen["first"].date())) & (day <= F.lit(seen["last"].date()))
        kept = kept & (time >= low) & (time <= high)
    return stored.filter(kept | day.isNull() if seen["without_time"] else kept)


def _stored_silver(
    spark: SparkSession, layers: Layers, batch_id: str, seen: dict, schema: T.StructType
) -> DataFrame:
    """Silver's rows of the stretch of time that the new ones span.

    Batches whose notes say that they lie elsewhere are not listed. The batch's own earlier form
    does not count, since it is replaced.
    """
    notes = tables.row_notes(spark, layers.rows("silver")).filter(F.col("batch_id") != batch_id)
    near = F.col("first").isNull() | F.col("last").isNull()
    if seen["first"] is not None:
        low, high = (F.lit(seen[c].date().isoformat()) for c in ("first", "last"))
        near = near | ((F.col("first") <= high) & (F.col("last") >= low))
    if seen["without_time"]:
        near = F.lit(True)
    # Names of the batches since compaction that share dates with this one.
    since = [row[0] for row in notes.filter(near).select("batch_id").collect()]
    found, held = tables.runs(spark, layers.base("silver"))
    since = [b for b in since if b not in held]
    rows = tables.read_some(spark, layers.silver, schema, since)
    rows = rows.unionByName(tables.read_runs(spark, layers.base("silver"), found, schema))
    return _same_times(rows.filter(F.col("batch_id") != batch_id), seen)


def write_silver(
    bronze: DataFrame, layers: Layers, batch_id: str, mode: str = "fail",
    max_rank: int | None = None, more: T.StructType | None = None,
) -> None:
    """Appends the batch's clean rows that Silver does not have, and notes what it did.

    ``fail`` commits nothing if a row to be added fails a check, ``quarantine`` sets failing
    rows apart first, ``report`` lets them pass. Ranks have no upper bound unless given.
    ``more`` names further columns of Bronze that Silver keeps.
    The notes count the batch's rows, not the layer's: those that came, were set apart, removed as
    copies, and added; failing rows by check (of the rows that came in quarantine mode, else
    of those to be added); and NULLs by column of the added rows; the added rows are counted while
    they are written. A batch that compaction has merged cannot be written again.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark, schema = bronze.sparkSession, with_more(SILVER, more)
    checks = snapshot_checks(max_rank)
    rows = clean(bronze)
    tables.create_batches(spark, layers.silver, SILVER)
    _not_held(spark, layers, "silver", batch_id)
    seen = _counted(rows, checks)
    stored = _stored_silver(spark, layers, batch_id, seen, schema)
    if mode == "quarantine":
        rows, failing = split_rows(rows, checks)
        tables.write_batch(failing, layers.quarantine, batch_id)
    rows = silver_increment(rows, stored, schema)
    metrics = [
        F.min(tables.DATE).alias("first"), F.max(tables.DATE).alias("last"),
        *failing_counters(checks), *null_counters(SILVER),
    ]
    kept = tables.stage_batch(rows, layers.silver, batch_id, SILVER_KEY, metrics)
    kept["n"] = kept["rows"]
    added = tables.read_staged(spark, layers.silver, batch_id, SILVER)
    report = _noted_checks(spark, checks, seen if mode == "quarantine" else kept, added)
    if mode == "fail":
        try:
            gate(report)
        except QualityError:
            tables.drop_staged(spark, layers.silver, batch_id)
            raise
    _note(report, layers, "checks", batch_id)
    set_apart = seen["any_failing"] if mode == "quarantine" else 0
    counts = [(seen["n"], set_apart, seen["n"] - set_apart - kept["n"], kept["n"])]
    _note(spark.createDataFrame(counts, NOTES["counts"]), layers, "counts", batch_id)
    nulls = [
        (name, kept[f"nulls_{i}"], 100.0 * kept[f"nulls_{i}"] / kept["n"])
        for i, name in enumerate(SILVER.names) if kept[f"nulls_{i}"]
    ]
    _note(spark.createDataFrame(nulls, NOTES["nulls"]), layers, "nulls", batch_id)
    _note_summary(added, layers, batch_id)
    tables.put_batch(spark, layers.silver, batch_id)
    first, last = (kept[c] for c in ("first", "last"))
    unknown = kept[f"nulls_{SILVER.names.index(tables.DATE)}"] > 0
    span = (None, None) if unknown else (first, last)
    tables.note_rows(spark, layers.rows("silver"), batch_id, kept["n"], *span)
    tables.commit(spark, layers.commits("silver"), batch_id)


def _noted_checks(
    spark: SparkSession, checks: list[Check], counted: dict, added: DataFrame
) -> DataFrame:
    """The report of the row checks from their counters, and of the key over the new rows."""
    rows = [(c.name, counted[f"failing_{i}"] == 0, counted[f"failing_{i}"])
            for i, c in enumerate(checks)]
    unique = check_report(added.select(*SILVER_KEY), [], SILVER_KEY)
    return spark.createDataFrame(rows, NOTES["checks"]).unionByName(unique)


def _note(rows: DataFrame, layers: Layers, table: str, batch_id: str) -> None:
    path = f"{layers.notes(table)}/batch_id={batch_id}"
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def compact(
    spark: SparkSession, layers: Layers, layer: str = "silver", more: T.StructType | None = None
) -> None:
    """Merges the complete batches of bronze, audit, silver or live_gold into runs, tables by date.

    Rows and their batches stay what they are; what shrinks is the number of folders to list.
    Which runs count is switched at once. Streams may go on meanwhile.
    """
    schema, order, commits = {
        "bronze": (BRONZE, ("symbol",), "bronze"), "audit": (AUDIT, (), "bronze"),
        "silver": (SILVER, SILVER_KEY, "silver"), "live_gold": (GOLD, SILVER_KEY, "gold"),
    }[layer]
    done = tables.committed(spark, layers.commits(commits))
    tables.merge_batches(
        spark, getattr(layers, layer), layers.base(layer), with_more(schema, more), done, order
    )


def compact_silver(spark: SparkSession, layers: Layers) -> None:
    compact(spark, layers, "silver")


def rebuild_gold(
    spark: SparkSession, layers: Layers, rows_per_part: int = ROWS_PER_PART,
    more: T.StructType | None = None,
) -> int:
    """Recomputes Gold from all of Silver and replaces it, whole or not at all; returns its rows."""
    silver = layers.read_silver(spark, more)
    cuts = find_cut_points(silver, Timeline(), rows_per_part)
    return tables.replace_layer(to_gold(silver, cuts=cuts), layers.gold, order=SILVER_KEY)


def run_cycle(
    spark: SparkSession,
    landing: str | list[str],
    layers: Layers,
    batch_id: str,
    endpoint: str,
    mode: str = "fail",
    multi_line: bool = True,
    max_rank: int | None = None,
    coin: T.StructType = COIN,
    status: T.StructType = STATUS,
) -> DataFrame:
    """One collection cycle over new landing files, from payloads to Gold.

    Returns (layer, new_rows, total_rows, snapshots). Any failure propagates; layers
    that were written before it stay, and running the same batch again completes it.
    """
    more = further_fields(coin)
    payloads = read_payloads(spark, landing, multi_line)
    write_bronze(payloads, layers, batch_id, endpoint, coin, status)
    bronze = layers.read_batches(spark, "bronze", with_more(BRONZE, more), [batch_id])
    write_silver(bronze, layers, batch_id, mode, max_rank, more)
    rebuild_gold(spark, layers, more=more)
    return cycle_summary(spark, layers, batch_id)


def cycle_summary(spark: SparkSession, layers: Layers, batch_id: str) -> DataFrame:
    """Row counts as noted while the batches were written and Gold was rebuilt, snapshots from the
    audit table of one row per payload. Gold is rebuilt whole, so all its rows are new."""
    counted = []
    for layer in ("bronze", "silver"):
        notes = tables.row_notes(spark, layers.rows(layer))
        new = F.sum(F.when(F.col("batch_id") == batch_id, F.col("rows")))
        row = notes.agg(new.alias("new"), F.sum("rows").alias("total")).first()
        counted.append((layer, row["new"] or 0, row["total"] or 0))
    rows = tables.current_rows(spark, layers.gold)
    counted.append(("gold", rows, rows))
    times = layers.read_audit(spark).filter("coins_returned > 0").select("collected_at")
    snapshots = times.agg(F.count_distinct("collected_at")).scalar()
    result = spark.createDataFrame(counted, "layer STRING, new_rows BIGINT, total_rows BIGINT")
    return result.withColumn("snapshots", snapshots)


def _note_summary(added: DataFrame, layers: Layers, batch_id: str) -> None:
    """A summary of the batch that can be merged with those of others."""
    _note(reports.summary(added), layers, "summary", batch_id)


def overview(spark: SparkSession, layers: Layers) -> DataFrame:
    """The overview of Silver from its batches' summaries, without a scan of its rows."""
    done = spark.createDataFrame(
        [(b,) for b in sorted(tables.committed(spark, layers.commits("silver")))], "batch_id STRING"
    )
    files.make_folder(spark, layers.notes("summary"))
    notes = layers.read_notes(spark, "summary").join(F.broadcast(done), "batch_id", "left_semi")
    return reports.merged_overview(notes)
