"""Small files on the layers' own file system, whichever Hadoop file system that is."""

from __future__ import annotations

import re
import time
from uuid import uuid4

from pyspark.sql import SparkSession

_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def checked_name(name: str) -> str:
    """A name that can stand in a path as it is."""
    if not _NAME.fullmatch(name):
        raise ValueError(f"use letters, digits, dot, dash and underscore only: {name!r}")
    return name


def _open(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _open(spark, path)
    return fs.exists(at)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, at = _open(spark, path)
    fs.mkdirs(at)


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _open(spark, path)
    fs.delete(at, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in one folder; none if there is no such folder."""
    fs, at = _open(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Renames a file or folder to a name that is not taken yet."""
    fs, at = _open(spark, target)
    fs.mkdirs(at.getParent())
    if fs.exists(at) or not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(source), at):
        raise OSError(f"cannot rename {source} to {target}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, complete as soon as it can be seen under its name.

    A file of that name goes first, so whoever needs one at all times writes numbered names
    (``write_newest``).
    """
    folder, name = path.rsplit("/", 1)
    hidden = f"{folder}/.{name}.{uuid4().hex[:8]}.tmp"
    fs, at = _open(spark, hidden)
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if exists(spark, path):
        delete(spark, path)
    rename(spark, hidden, path)


def _numbered(spark: SparkSession, path: str) -> list[str]:
    folder, name = path.rsplit("/", 1)
    return [n for n in names(spark, folder) if re.fullmatch(re.escape(name) + r"-\d{20}", n)]


def write_newest(spark: SparkSession, path: str, text: str, keep: int = 2) -> list[str]:
    """A new form of a small text; the newest one counts from the moment it can be seen.

    No name is ever written twice, so at no moment is there none. Forms older than the ``keep``
    newest go; the texts of those that stay are returned, the newest last.
    """
    folder = path.rsplit("/", 1)[0]
    before = _numbered(spark, path)
    number = max(time.time_ns(), int(before[-1][-20:]) + 1 if before else 0)
    write_text(spark, f"{path}-{number:020d}", text)
    stay = _numbered(spark, path)
    for name in stay[:-keep]:
        delete(spark, f"{folder}/{name}")
    return [read_text(spark, f"{folder}/{n}") or "" for n in stay[-keep:]]


def read_newest(spark: SparkSession, path: str) -> str | None:
    found = _numbered(spark, path)
    return read_text(spark, f"{path.rsplit('/', 1)[0]}/{found[-1]}") if found else None


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is no such file."""
    fs, at = _open(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
