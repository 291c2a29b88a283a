"""What the operators share: written intermediate tables, row keys, label splits."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import scratch_path, ship  # noqa: F401

# Text that a task handles at once, so that its memory does not follow the batch size.
SLICE_BYTES = 2 << 20


def written(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """The rows as a table in the shared scratch folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """``written`` for as long as the block lasts; then the files are deleted."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def identity(*columns: str) -> list[Column]:
    """Two independent 64-bit hashes of a row's values; nulls and empty texts differ."""
    flags = [F.col(c).isNull() for c in columns]
    values = [F.col(c) for c in columns]
    return [
        F.xxhash64(F.lit(1), *flags, *values).alias("key_a"),
        F.xxhash64(F.lit(2), *reversed(values), *flags).alias("key_b"),
    ]


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's text modulo ``divisor``; a null id counts as empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(divisor))


def rows_with_keys(docs: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """One row of ``docs`` for each id and text whose two keys ``keys`` holds."""
    pair = docs.select(*columns, *identity("doc_id", "text"))
    return (
        pair.join(keys.select("key_a", "key_b"), ["key_a", "key_b"], "left_semi")
        .dropDuplicates(["key_a", "key_b"])
        .select(*columns)
    )


def texts(column: pa.Array) -> pa.LargeBinaryArray:
    """UTF-8 bytes of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())


def layout(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins (one more entry than texts)."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset : column.offset + len(column) + 1
    ]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches in stretches of rows with about ``SLICE_BYTES`` of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = layout(texts(batch.column(text)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + SLICE_BYTES, "right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end
