"""Raw payloads from a landing folder of JSON files, as a batch or as a stream.

One payload is an object with ``status`` and ``data``. Files hold one payload each
(``multi_line``) or one per line; only the latter can be split among tasks. The status and the
records stay JSON text unless their schemas are given, so no field is lost; ``layers.parsed``
types the declared ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLACE = "payload_place"
_CORRUPT = "_corrupt_record"
# The text of a payload that the reader could not parse.
RAW = "raw_payload"


def payload_schema(
    coin: T.StructType | None = None, status: T.StructType | None = None
) -> T.StructType:
    """Schema of a landing file; what has no schema stays JSON text."""
    return T.StructType([
        T.StructField("status", T.StringType() if status is None else status),
        T.StructField("data", T.ArrayType(T.StringType() if coin is None else coin)),
        T.StructField("collected_at", T.StringType()),
        T.StructField(_CORRUPT, T.StringType()),
    ])


def origin_columns() -> dict[str, Column]:
    """When a row's file arrived, which one it is, and where in it the row stands.

    A split of a file is read in order by one task, so the running number of a row within
    its task orders the rows of a split.
    """
    return {
        "file_time": F.col("_metadata.file_modification_time"),
        "source_file": F.col("_metadata.file_path"),
        "block_start": F.col("_metadata.file_block_start"),
        PLACE: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    }


def _payloads(raw: DataFrame) -> DataFrame:
    arrived = F.date_format("_metadata.file_modification_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    origin = origin_columns()
    if raw.isStreaming:
        del origin[PLACE]
    return raw.select(
        "status",
        "data",
        F.coalesce("collected_at", arrived).alias("collected_at"),
        *[c.alias(name) for name, c in origin.items()],
        F.col(_CORRUPT).isNotNull().alias("malformed"),
        F.col(_CORRUPT).alias(RAW),
    )


def read_payloads(
    spark: SparkSession,
    path: str | list[str],
    multi_line: bool = True,
    coin: T.StructType | None = None,
    status: T.StructType | None = None,
) -> DataFrame:
    """Payload rows: status, data, collected_at, where they came from, malformed.

    ``collected_at`` is the payload's own stamp, else the time its file arrived, so the
    listings and the audit row of one payload always agree. A file that is no valid
    payload gives a row with ``malformed`` set. With a ``coin`` or ``status`` schema the
    reader parses these parts and drops the fields that the schema lacks.
    """
    reader = spark.read.schema(payload_schema(coin, status))
    raw = reader.option("multiLine", multi_line).option("columnNameOfCorruptRecord", _CORRUPT)
    return _payloads(raw.json(path))


def stream_payloads(
    spark: SparkSession,
    path: str,
    multi_line: bool = True,
    files_per_batch: int | None = None,
    coin: T.StructType | None = None,
    status: T.StructType | None = None,
) -> DataFrame:
    """Streaming form of ``read_payloads``: each landing file is taken once.

    A stream cannot number its rows; ``with_place`` does it in each micro-batch.
    """
    reader = spark.readStream.schema(payload_schema(coin, status))
    reader = reader.option("multiLine", multi_line).option("columnNameOfCorruptRecord", _CORRUPT)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return _payloads(reader.json(path))


def with_place(payloads: DataFrame) -> DataFrame:
    """A micro-batch of ``stream_payloads`` with the place of its rows in their task."""
    return payloads.withColumn(PLACE, origin_columns()[PLACE])
