"""Stored layers as Parquet, and CSV exchange by column name.

Append-only layers hold one directory per batch, partitioned by date below it. A batch is
written aside and renamed; one that is run again gets a directory of its own beside the old one,
and counts in its place once it is marked as done. A batch that is complete has a record in a
folder of commits, by which streams hand it on, once. Batches can be merged into runs, tables
by date over many batches.

What is replaced whole gets a new version next to the old one. Which one counts, or which runs
do, is in small files of rising number, of which the newest complete one is read. No name is
written twice and nothing is deleted before what replaces it can be seen, so readers see the old
rows or the new ones wherever a driver is lost.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.nested import arrays_to_json
from tidemark.sources import files
from tidemark.sources.landing import origin_columns
from tidemark.sources.schemas import with_batch

DATE = "snapshot_date"

# Quotes are doubled, as most CSV writers do; times keep their microseconds.
_CSV = {
    "header": "true",
    "escape": '"',
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def _lenient_cast(c: Column, to: T.DataType) -> Column:
    direct = c.try_cast(to)
    if isinstance(to, T.IntegralType):
        # Writers without nullable integers store them as text like "1027.0".
        return F.coalesce(direct, c.try_cast("double").try_cast(to))
    return direct


def conform(df: DataFrame, schema: T.StructType, lenient: bool = False) -> DataFrame:
    """Exactly the schema's columns, matched by name, missing ones NULL.

    ``lenient`` turns values that do not fit their type into NULL instead of an error.
    """
    present = {c.lower(): c for c in df.columns}
    columns = []
    for field in schema.fields:
        name = present.get(field.name.lower())
        c = F.lit(None) if name is None else F.col(f"`{name}`")
        cast = _lenient_cast(c, field.dataType) if lenient else c.cast(field.dataType)
        columns.append(cast.alias(field.name))
    return df.select(*columns)


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table that Spark plans away, where one made of Python rows costs its tasks."""
    columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return spark.range(1).filter(F.lit(False)).select(*columns)


def create_layer(
    spark: SparkSession, path: str, schema: T.StructType, by: Sequence[str]
) -> None:
    """An empty table at ``path``, unless there is one."""
    no_rows(spark, schema).write.mode("ignore").partitionBy(*by).parquet(path)


def create_batches(spark: SparkSession, path: str, schema: T.StructType) -> None:
    create_layer(spark, path, with_batch(schema), ["batch_id", DATE])


def read_layer(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


_STAGED, _DONE, _AGAIN = "_staged", "_done", "~"


def _folders(spark: SparkSession, path: str) -> tuple[dict[str, str], list[str]]:
    """The newest complete folder of each batch, and the folders that do not count."""
    present = [n.split("=", 1)[1] for n in files.names(spark, path) if n.startswith("batch_id=")]
    done, newest = set(files.names(spark, f"{path}/{_DONE}")), {}
    for name in sorted(n for n in present if n in done):
        newest[name.split(_AGAIN)[0]] = name
    return newest, sorted(set(present) - set(newest.values()))


def _plain_id(rows: DataFrame, found: Iterable[str]) -> DataFrame:
    if not any(_AGAIN in name for name in found):
        return rows
    plain = F.regexp_replace("batch_id", f"{_AGAIN}.*", "")
    return rows.withColumn("batch_id", plain)


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    rows = read_layer(spark, path, with_batch(schema))
    newest, others = _folders(spark, path)
    if others:
        rows = rows.filter(~F.col("batch_id").isin(others))
    return _plain_id(rows, newest.values())


def read_some(
    spark: SparkSession, path: str, schema: T.StructType, batch_ids: Iterable[str]
) -> DataFrame:
    """The rows of these batches; no other directory is listed."""
    wanted = sorted({files.checked_name(b) for b in batch_ids})
    newest = _folders(spark, path)[0] if wanted else {}
    found = [newest[b] for b in wanted if b in newest]
    if not found:
        return no_rows(spark, with_batch(schema))
    reader = spark.read.schema(with_batch(schema)).option("basePath", path)
    return _plain_id(reader.parquet(*[f"{path}/batch_id={f}" for f in found]), found)


def commit(spark: SparkSession, folder: str, batch_id: str, took: Sequence[str] = ()) -> None:
    """Notes that a batch is complete, and which batches it took in. The first note stays."""
    path = f"{folder}/{files.checked_name(batch_id)}.json"
    if not files.exists(spark, path):
        note = json.dumps({"batch_id": batch_id, "took": list(took)})
        files.write_text(spark, path, note + "\n")


def is_committed(spark: SparkSession, folder: str, batch_id: str) -> bool:
    return files.exists(spark, f"{folder}/{files.checked_name(batch_id)}.json")


_COMMIT = "batch_id STRING, took ARRAY<STRING>"


def read_commits(spark: SparkSession, folder: str) -> DataFrame:
    files.make_folder(spark, folder)
    return spark.read.schema(_COMMIT).json(folder)


def stream_commits(spark: SparkSession, folder: str, per_trigger: int | None) -> DataFrame:
    """Batches as they become complete; a batch that is written again does not come again."""
    files.make_folder(spark, folder)
    reader = spark.readStream.schema(_COMMIT)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.json(folder)


def _by_date(df: DataFrame, order: Sequence[str]) -> DataFrame:
    # Without rebalancing every task would write a file for every date it holds. AQE sizes the
    # write tasks: it merges small dates and splits a date that is too big for one.
    rows = df.hint("rebalance", DATE)
    # Writing by date sorts by date anyway; the rest of the order lets a filter on the key
    # skip row groups.
    return rows.sortWithinPartitions(DATE, *order) if order else rows


def append(df: DataFrame, path: str, partitions: Sequence[str] = (DATE,)) -> None:
    df.write.mode("append").partitionBy(*partitions).parquet(path)


def write_batch(
    df: DataFrame, path: str, batch_id: str, order: Sequence[str] = (),
    metrics: Sequence[Column] = (), dense: bool = False,
) -> dict:
    """Writes or replaces one batch of an append-only layer, its files sorted by ``order``.

    Returns its ``rows`` and other aggregates, which are counted while it is written. Rows that
    repeat long texts, and so are far larger in memory than shuffled, are ``dense``.
    """
    counted = stage_batch(df, path, batch_id, order, metrics, dense)
    put_batch(df.sparkSession, path, batch_id)
    return counted


def stage_batch(
    df: DataFrame, path: str, batch_id: str, order: Sequence[str] = (),
    metrics: Sequence[Column] = (), dense: bool = False,
) -> dict:
    """Writes a batch aside, where readers do not see it yet."""
    target = f"{path}/{_STAGED}/batch_id={files.checked_name(batch_id)}"
    return _written(df, target, order, metrics, dense)


# How many rows of a task and a date go on together, and what a task takes of them as shuffled.
_DENSE_ROWS, _DENSE_BYTES = 100_000, 8 << 20
_STRETCH, _ADVISORY = "_stretch", "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def _written(
    df: DataFrame, target: str, order: Sequence[str], metrics: Sequence[Column],
    dense: bool = False,
) -> dict:
    # Counted in the tasks that write, of which each counts once.
    seen, conf = Observation(), df.sparkSession.conf
    advised = conf.get(_ADVISORY)
    if dense:
        # AQE cannot split what one task sends of one date.
        row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        rows = df.withColumn(_STRETCH, F.floor(row / _DENSE_ROWS))
        rows = rows.hint("rebalance", DATE, _STRETCH).drop(_STRETCH)
        conf.set(_ADVISORY, _DENSE_BYTES)
    else:
        rows = df.hint("rebalance", DATE)
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics)
    rows = rows.sortWithinPartitions(DATE, *order) if order else rows
    try:
        rows.write.mode("overwrite").partitionBy(DATE).parquet(target)
    finally:
        if dense:
            conf.set(_ADVISORY, advised)
    return seen.get


def read_staged(spark: SparkSession, path: str, batch_id: str, schema: T.StructType) -> DataFrame:
    return read_layer(spark, f"{path}/{_STAGED}/batch_id={batch_id}", schema)


def drop_staged(spark: SparkSession, path: str, batch_id: str) -> None:
    files.delete(spark, f"{path}/{_STAGED}/batch_id={batch_id}")


def put_batch(spark: SparkSession, path: str, batch_id: str) -> None:
    """Lets a batch that was written aside count, in place of its older form if it has one."""
    staged = f"{path}/{_STAGED}/batch_id={batch_id}"
    present = {n.split("=", 1)[1] for n in files.names(spark, path) if n.startswith("batch_id=")}
    older = sorted(n for n in present if n.split(_AGAIN)[0] == batch_id)
    name = f"{batch_id}{_AGAIN}{time.time_ns():020d}" if older else batch_id
    files.rename(spark, staged, f"{path}/batch_id={name}")
    files.write_text(spark, f"{path}/{_DONE}/{name}", "")
    for other in older:
        files.delete(spark, f"{path}/{_DONE}/{other}")
        files.delete(spark, f"{path}/batch_id={other}")


def drop_batch(spark: SparkSession, path: str, batch_id: str) -> None:
    for name in files.names(spark, path):
        if name.startswith("batch_id=") and name[9:].split(_AGAIN)[0] == batch_id:
            files.delete(spark, f"{path}/{_DONE}/{name[9:]}")
            files.delete(spark, f"{path}/{name}")


_CURRENT, _LABEL = "_current", re.compile(r"stream-(\d{12})")


def replace_layer(df: DataFrame, path: str, order: Sequence[str] = ()) -> int:
    """Replaces a whole layer by a new version and returns its rows; ``df`` may read the old one.

    The version before it stays for readers that have begun; older ones are deleted.
    """
    spark = df.sparkSession
    version = f"v-{time.time_ns():020d}-{uuid4().hex[:8]}"
    rows = _written(df, f"{path}/{version}", order, ())["rows"]
    note = json.dumps({"version": version, "rows": rows})
    stay = {json.loads(t)["version"] for t in files.write_newest(spark, f"{path}/{_CURRENT}", note)}
    for name in files.names(spark, path):
        # A later version may be in the making.
        if name.startswith("v-") and name not in stay and name < version:
            files.delete(spark, f"{path}/{name}")
    return rows


def _current(spark: SparkSession, path: str) -> dict:
    text = files.read_newest(spark, f"{path}/{_CURRENT}")
    return json.loads(text) if text else {}


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the version that counts, or None if the layer was never written."""
    now = _current(spark, path)
    return f"{path}/{now['version']}" if now else None


def current_rows(spark: SparkSession, path: str) -> int:
    return _current(spark, path).get("rows", 0)


@dataclass(frozen=True)
class Held:
    """Batches that are merged: all of a stream up to a number, and others by name."""

    upto: int = -1
    names: frozenset[str] = frozenset()

    def __contains__(self, batch_id: str) -> bool:
        found = _LABEL.fullmatch(batch_id)
        return batch_id in self.names or bool(found and int(found[1]) <= self.upto)

    def __bool__(self) -> bool:
        return self.upto >= 0 or bool(self.names)

    def plus(self, batch_ids: Iterable[str]) -> Held:
        """With more batches; numbers that follow on raise the mark instead of adding names."""
        names = set(self.names) | {b for b in batch_ids if b not in self}
        upto = self.upto
        while f"stream-{upto + 1:012d}" in names:
            upto += 1
            names.discard(f"stream-{upto:012d}")
        return Held(upto, frozenset(names))


@dataclass(frozen=True)
class Run:
    """A table by date that is made of many batches."""

    folder: str
    rows: int


def runs(spark: SparkSession, path: str) -> tuple[list[Run], Held]:
    """The runs of a layer, oldest and largest first, and the batches they are made of."""
    now = _current(spark, path)
    held = Held(now.get("upto", -1), frozenset(now.get("names", ())))
    return [Run(r["folder"], r["rows"]) for r in now.get("runs", ())], held


def read_runs(spark: SparkSession, path: str, found: Sequence[Run], schema: T.StructType) -> DataFrame:
    tables = [read_layer(spark, f"{path}/{r.folder}", with_batch(schema)) for r in found]
    return reduce(DataFrame.unionByName, tables) if tables else no_rows(spark, with_batch(schema))


# A run is written again with a new one only if that is at least this part of its size.
_GROWTH = 4


def merge_batches(
    spark: SparkSession, path: str, base: str, schema: T.StructType, done: Iterable[str],
    order: Sequence[str] = (),
) -> None:
    """Merges batches that are complete into runs below ``base``.

    New batches become a run, together with the runs before it that are not much larger, so a
    row is written again a few times in all, not at every merge. Rows keep their batches. The
    folders of batches merged now stay for readers that have begun; those of batches merged
    before are deleted.
    """
    now, held = runs(spark, base)
    fresh = sorted({b for b in done if b not in held} & batch_ids(spark, path))
    if fresh:
        rows = read_some(spark, path, schema, fresh)
        size, merged, kept = rows.count(), [], list(now)
        while kept and kept[-1].rows <= _GROWTH * size:
            merged.append(kept.pop())
            size += merged[-1].rows
        both = rows.unionByName(read_runs(spark, base, merged, schema))
        folder = f"r-{time.time_ns():020d}-{uuid4().hex[:8]}"
        _written(both, f"{base}/{folder}", order, ())
        every, after = [*kept, Run(folder, size)], held.plus(fresh)
        note = {
            "runs": [{"folder": r.folder, "rows": r.rows} for r in every],
            "upto": after.upto, "names": sorted(after.names),
        }
        texts = files.write_newest(spark, f"{base}/{_CURRENT}", json.dumps(note))
        stay = {r["folder"] for text in texts for r in json.loads(text)["runs"]}
        for name in files.names(spark, base):
            if name.startswith("r-") and name not in stay and name < folder:
                files.delete(spark, f"{base}/{name}")
    for batch_id in sorted(b for b in batch_ids(spark, path) if b in held):
        drop_batch(spark, path, batch_id)


def batch_ids(spark: SparkSession, path: str) -> set[str]:
    """Batches that have a folder of their own, from one listing."""
    return set(_folders(spark, path)[0])


_COUNTED = "batch_id STRING, rows BIGINT, first STRING, last STRING, number BIGINT"


def note_rows(
    spark: SparkSession, folder: str, batch_id: str, rows: int, first: date | None = None,
    last: date | None = None,
) -> None:
    """Notes how many rows a batch has, and the dates they span."""
    span = {k: v and v.isoformat() for k, v in {"first": first, "last": last}.items()}
    note = {"batch_id": batch_id, "rows": rows, **span, "number": time.time_ns()}
    files.write_newest(spark, f"{folder}/{files.checked_name(batch_id)}", json.dumps(note) + "\n")


def row_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The newest note of every batch."""
    files.make_folder(spark, folder)
    newest = F.max_by(F.struct("rows", "first", "last"), "number").alias("n")
    return spark.read.schema(_COUNTED).json(folder).groupBy("batch_id").agg(newest).select(
        "batch_id", "n.*"
    )


def committed(spark: SparkSession, folder: str) -> set[str]:
    names = files.names(spark, folder)
    return {n.removesuffix(".json") for n in names if n[0] not in "._" and n.endswith(".json")}


def read_current(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    version = current_version(spark, path)
    return no_rows(spark, schema) if version is None else read_layer(spark, version, schema)


def last_date(spark: SparkSession, folder: str) -> date | None:
    """The last date of a table partitioned by it, from the names of its folders."""
    days = [n.split("=", 1)[1] for n in files.names(spark, folder) if n.startswith(f"{DATE}=")]
    found = [d for d in days if d[:1].isdigit()]
    return date.fromisoformat(max(found)) if found else None


def overwrite(
    df: DataFrame, path: str, by_date: bool = True, order: Sequence[str] = ()
) -> None:
    """Replaces a whole layer; ``path`` must not be one that ``df`` reads."""
    if by_date:
        _by_date(df, order).write.mode("overwrite").partitionBy(DATE).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """A folder of CSV parts with headers; nested arrays become JSON text."""
    arrays_to_json(df).write.mode("overwrite").options(**_CSV).csv(path)


def import_csv(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, lenient: bool = True
) -> DataFrame:
    """CSV files of differing column orders as one table, every column found by its name.

    Each path may hold files of one layout. Values are read as text and cast, so a
    layout without a column gives NULLs there, but for the columns of ``origin_columns``:
    these then say where the row stands in the files.
    """
    result = None
    for path in paths:
        text = spark.read.options(**_CSV).csv(path)
        given = {c.lower() for c in text.columns}
        text = text.select(
            "*", *[c.alias(n) for n, c in origin_columns().items() if n not in given]
        )
        rows = conform(text, schema, lenient)
        result = rows if result is None else result.unionByName(rows)
    if result is None:
        raise ValueError("no path given")
    return result
