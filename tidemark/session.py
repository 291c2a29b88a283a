"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import zipfile
from functools import cache
from pathlib import Path
from uuid import uuid4

from pyspark.sql import SparkSession

# What the results depend on. ANSI mode stays on, as is Spark's default.
SEMANTICS = {"spark.sql.session.timeZone": "UTC"}

# What long jobs on large tables want; all are Spark settings, none is required.
AT_SCALE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
}


def apply_semantics(spark: SparkSession) -> SparkSession:
    for name, value in SEMANTICS.items():
        spark.conf.set(name, value)
    return spark


def shuffle_partitions(shuffle_bytes: int, cores: int, target_bytes: int = 256 << 20) -> int:
    """Partitions of about ``target_bytes``, at least two waves of tasks; AQE merges small ones."""
    return max(2 * cores, -(-shuffle_bytes // target_bytes))


@cache
def _local_scratch() -> str:
    folder = tempfile.mkdtemp(prefix="tidemark-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path for written intermediate tables, in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``. Only a local session may go
    without one, since no other machine has to see its files; it has one folder, which
    goes when the driver ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_scratch()
    return f"{base.rstrip('/')}/{label}-{uuid4().hex}"


def ship(spark: SparkSession) -> None:
    """Gives executors this package's code, where they do not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    target = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark.zip"
    target.write_bytes(packed.getvalue())
    context.addPyFile(str(target))
    context._tidemark_shipped = True
