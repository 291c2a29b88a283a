"""Exact duplicates by a tree of merges of sorted digest runs.

Every task turns its rows into runs sorted by digest, one entry per distinct text. Runs are
cut into digest ranges, and in each round the runs of ``fan_in`` neighbours meet range by
range, are merged in digest order, and keep one entry per text: the best row and the number
of copies. After ``log(runs) / log(fan_in)`` rounds one run per range is left. Copies shrink
to one entry per task before anything is shuffled, so a text that makes up a third of all
rows weighs no more than any other, and no task holds more than ``range_rows`` texts.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.rows import identity, rows_with_keys, ship, slices, texts, written

_WHITE = b" \t\n\r\x0b\x0c"
_DIGESTS = (
    "row_id long, doc_id long, key_a long, key_b long, points long, digest binary, proof long"
)
_RUN = (
    "part long, run long, digest binary, proof long, points long, doc_id long, row_id long, "
    "copies long"
)
_RUN_FIELDS = pa.schema([
    ("part", pa.int64()), ("run", pa.int64()), ("digest", pa.binary()), ("proof", pa.int64()),
    ("points", pa.int64()), ("doc_id", pa.int64()), ("row_id", pa.int64()),
    ("copies", pa.int64()),
])


def digests(docs: DataFrame) -> DataFrame:
    """A row per document: id, code points, SHA-256 of the text without white space, proof.

    ``proof`` holds length and CRC of the same bytes; entries merge only if both agree.
    """
    named = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        *identity("doc_id", "text"),
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            column = texts(batch.column("text"))
            plain = [t.translate(None, _WHITE) for t in column.to_pylist()]
            proofs = [zlib.crc32(t) | (len(t) & 0x7FFFFFFF) << 32 for t in plain]
            yield pa.RecordBatch.from_pydict({
                **{c: batch.column(c) for c in ("row_id", "doc_id", "key_a", "key_b")},
                "points": pc.utf8_length(column.cast(pa.large_string())).cast(pa.int64()),
                "digest": pa.array([hashlib.sha256(t).digest() for t in plain], pa.binary()),
                "proof": pa.array(proofs, pa.int64()),
            })

    return named.mapInArrow(digest, _DIGESTS)


def merged(entries: pa.Table) -> pa.Table:
    """One entry per digest and proof, in their order: the best row, and the copies added up."""
    if not entries.num_rows:
        return entries
    order = pc.sort_indices(
        entries,
        sort_keys=[
            ("digest", "ascending"), ("proof", "ascending"), ("points", "descending"),
            ("doc_id", "ascending"), ("row_id", "ascending"),
        ],
        null_placement="at_end",
    )
    entries = entries.take(order).combine_chunks()
    digest, proof = entries["digest"], entries["proof"]
    new = np.ones(entries.num_rows, bool)
    if entries.num_rows > 1:
        new[1:] = ~(
            pc.equal(digest[1:], digest[:-1]).to_numpy(zero_copy_only=False)
            & pc.equal(proof[1:], proof[:-1]).to_numpy(zero_copy_only=False)
        )
    first = np.flatnonzero(new)
    copies = np.add.reduceat(entries["copies"].to_numpy(), first)
    kept = entries.take(pa.array(first))
    return kept.set_column(kept.schema.get_field_index("copies"), "copies", pa.array(copies))


def _part_of(digest: pa.Array, parts: int) -> pa.Array:
    heads = np.array([int.from_bytes(d[:4], "big") for d in digest.to_pylist()], np.int64)
    return pa.array(heads * parts >> 32, pa.int64())


def winners(
    rows: DataFrame, fan_in: int = 8, range_rows: int = 200_000, run_rows: int = 100_000
) -> DataFrame:
    """digest, proof, points, doc_id, row_id, copies: the row that stays for each text.

    ``rows`` is the written result of ``digests``. A run holds at most ``run_rows`` entries.
    """
    parts = max(1, -(-rows.count() // range_rows))
    runs = max(1, rows.rdd.getNumPartitions())

    def sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run = TaskContext.get().partitionId()
        held: list[pa.Table] = []

        def flush() -> Iterator[pa.RecordBatch]:
            entries = merged(pa.concat_tables(held))
            held[:] = [entries]
            if entries.num_rows >= run_rows // 2:
                yield from close()

        def close() -> Iterator[pa.RecordBatch]:
            entries = merged(pa.concat_tables(held)) if held else None
            held.clear()
            if entries is not None and entries.num_rows:
                digest = entries["digest"].combine_chunks()
                out = entries.append_column("part", _part_of(digest, parts)).append_column(
                    "run", pa.array(np.full(entries.num_rows, run))
                )
                yield from out.select(_RUN_FIELDS.names).cast(_RUN_FIELDS).to_batches()

        for batch in batches:
            for begin in range(0, batch.num_rows, run_rows):
                piece = pa.Table.from_batches([batch.slice(begin, run_rows)])
                ones = pa.array(np.ones(piece.num_rows, np.int64))
                held.append(piece.append_column("copies", ones))
                if sum(t.num_rows for t in held) >= run_rows:
                    yield from flush()
        yield from close()

    def merge(group: pa.Table) -> pa.Table:
        return merged(group).cast(_RUN_FIELDS)

    table = rows.select("digest", "proof", "points", "doc_id", "row_id").mapInArrow(
        sorted_runs, _RUN
    )
    while True:
        runs = -(-runs // fan_in)
        table = (
            table.withColumn("run", F.floor(F.col("run") / fan_in).cast("long"))
            .groupBy("part", "run")
            .applyInArrow(merge, _RUN)
        )
        if runs == 1:
            return table.drop("part", "run")


def exact_groups(docs: DataFrame, **settings: int) -> DataFrame:
    """A row per row of ``docs``: the group of equal texts it is in, and whether it stays.

    Texts are equal when the same after deleting ASCII white space; null counts as empty, and
    all empty texts are equal. The row with the most code points stays, then the smallest
    doc_id (null ids last); of rows that repeat in both, exactly one. Other columns of
    ``docs`` are not read. Columns: row_id, doc_id, key_a, key_b, digest, keep_id, group_size,
    kept. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    rows = written(digests(docs), "digests")
    best = winners(rows, **settings).select(
        "digest",
        "proof",
        F.col("doc_id").alias("keep_id"),
        F.col("row_id").alias("keep_row"),
        F.col("copies").alias("group_size"),
    )
    return rows.join(best, ["digest", "proof"]).select(
        "row_id", "doc_id", "key_a", "key_b", "digest", "keep_id", "group_size",
        (F.col("row_id") == F.col("keep_row")).alias("kept"),
    )


def without_copies(docs: DataFrame, columns: list[str], **settings: int) -> DataFrame:
    """The rows of ``docs`` that stay, with ``columns`` (doc_id and text among them)."""
    kept = exact_groups(docs.select(*columns), **settings).filter("kept")
    return rows_with_keys(docs, kept, columns)
