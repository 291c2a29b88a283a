"""Packing by concatenation: two passes of prefix sums, then fixed windows.

The first pass encodes every document once, and writes its ids with the number of ids before
it in its partition. The partitions' totals, added up in order, give each partition its place
in one long stream. The second pass reads the ids back where they lie and cuts the stream
into windows; a document that crosses a window's end has a piece in each. No ids are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.encoding import Encoder, encoder
from tidemark.llm.rows import ship, slices, texts, written

END_ID = 1


def encoded(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids with ``end_id`` behind, their number, the partition and the ids before."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        own = encoder(vocabulary)
        for batch in slices(batches, "text"):
            ids, counts = own.encode(texts(batch.column("text")))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            tokens = counts + 1
            ends = np.concatenate([[0], np.cumsum(tokens)]) * own.dtype.itemsize
            cells = [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"),
                "ids": pa.Array.from_buffers(pa.binary(), len(tokens), cells),
                "doc_tokens": pa.array(tokens),
                "part": pa.array(np.full(len(tokens), part, np.int64)),
                "before": pa.array(before + np.cumsum(tokens) - tokens),
            })
            before += int(tokens.sum())

    return named.mapInArrow(
        encode, "doc_id long, ids binary, doc_tokens long, part long, before long"
    )


def packed(
    docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """A row per piece of a document in a window of ``window`` token ids.

    doc_id, start (ids of the document before the piece), length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers), doc_tokens, sequence_id, offset (in the window),
    and ids if ``with_ids``. Sequences are full but for the last one. A null or empty text is
    its end id alone; rows that repeat and rows with a null doc_id are packed like any other.
    Columns other than doc_id and text are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    dtype = Encoder(vocabulary).dtype
    width = dtype.itemsize
    rows = written(encoded(docs, vocabulary, end_id), "ids")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the first pass.
    bases = rows.groupBy("part").agg(F.sum("doc_tokens").alias("tokens")).select(
        "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0).cast("long")).alias("base")
    )
    # 16 bytes for each task of the first pass: a few MB for a hundred thousand tasks.
    placed = rows.join(F.broadcast(bases), "part").select(
        "doc_id", "ids", "doc_tokens", (F.col("base") + F.col("before")).alias("place")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("doc_tokens").to_numpy()
            place = batch.column("place").to_numpy()
            pieces = (place + tokens - 1) // window - place // window + 1
            owner = np.repeat(np.arange(len(tokens)), pieces)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = place[owner] // window + nth
            first = np.maximum(sequence * window, place[owner])
            last = np.minimum((sequence + 1) * window, place[owner] + tokens[owner])
            start = first - place[owner]
            ids = batch.column("ids")
            held, crcs, cuts = -1, [], []
            for i, a, b in zip(owner.tolist(), start.tolist(), (last - first).tolist()):
                if i != held:
                    held, buffer = i, ids[i].as_buffer()
                piece = np.frombuffer(buffer, dtype, b, a * width).astype("<u4")
                crcs.append(zlib.crc32(piece))
                if with_ids:
                    cuts.append(piece.tobytes())
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(owner)),
                "start": pa.array(start),
                "length": pa.array(last - first),
                "ids_crc32": pa.array(crcs, pa.int64()),
                "doc_tokens": pa.array(tokens[owner]),
                "sequence_id": pa.array(sequence),
                "offset": pa.array(first - sequence * window),
            }
            if with_ids:
                columns["ids"] = pa.array(cuts, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long" + ", ids binary" * with_ids
    )
    return placed.mapInArrow(cut, schema)
