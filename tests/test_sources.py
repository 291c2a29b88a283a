from datetime import datetime

import pytest

from tidemark.session import scratch_path, shuffle_partitions
from tidemark.sources import files, tables
from tidemark.sources.schemas import _struct
from pyspark.sql import types as T

SCHEMA = _struct(
    symbol=T.StringType(), platform_id=T.LongType(), price=T.DoubleType(),
    at=T.TimestampType(), flag=T.BooleanType(),
)


def text(path, content):
    path.mkdir()
    (path / "part.csv").write_text(content)
    return str(path)


def test_csv_layouts_are_matched_by_name(spark, tmp_path):
    one = text(tmp_path / "one", "symbol,price,platform_id,flag,at\n"
               "BTC,1.5,,True,2026-05-22 14:17:13+00:00\n"
               "\"A \"\"q\"\", b\",2.0,1027.0,False,2026-05-22T14:17:13.123456+00:00\n")
    two = text(tmp_path / "two", "at,flag,symbol,extra\njunk,True,ETH,9\n")
    got = {r["symbol"]: r for r in tables.import_csv(spark, [one, two], SCHEMA).collect()}
    assert got["BTC"]["platform_id"] is None and got["BTC"]["flag"] is True
    assert got['A "q", b']["platform_id"] == 1027 and got['A "q", b']["price"] == 2.0
    assert got["ETH"]["price"] is None and got["ETH"]["at"] is None


def test_strict_import_raises_on_junk(spark, tmp_path):
    path = text(tmp_path / "one", "symbol,price\nBTC,abc\n")
    with pytest.raises(Exception, match="abc"):
        tables.import_csv(spark, [path], SCHEMA, lenient=False).collect()


def test_export_keeps_microseconds_and_arrays_as_json(spark, tmp_path):
    path = str(tmp_path / "out")
    when = datetime(2026, 5, 22, 14, 17, 13, 123456)
    df = spark.createDataFrame(
        [(1, when, ["a", "b"], 'say "x", y')],
        "i INT, t TIMESTAMP_NTZ, tags ARRAY<STRING>, s STRING",
    )
    tables.export_csv(df, path)
    schema = T.StructType([*df.schema.fields[:2], T.StructField("tags", T.StringType()),
                           df.schema["s"]])
    assert [tuple(r) for r in tables.import_csv(spark, [path], schema).collect()] == [
        (1, when, '["a","b"]', 'say "x", y')
    ]


def test_a_batch_written_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "layer")
    df = spark.createDataFrame([("a",), ("b",)], "s STRING").selectExpr(
        "s", "DATE'2026-01-01' AS snapshot_date")
    schema = df.schema
    tables.create_batches(spark, path, schema)
    assert tables.read_batches(spark, path, schema).count() == 0
    tables.write_batch(df, path, "x")
    tables.write_batch(df, path, "y")
    tables.write_batch(df.filter("s = 'a'"), path, "y")
    tables.create_batches(spark, path, schema)
    got = tables.read_batches(spark, path, schema)
    assert sorted((r["batch_id"], r["s"]) for r in got.collect()) == [
        ("x", "a"), ("x", "b"), ("y", "a")]


def test_scratch_lies_in_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one.startswith(shared) and one != two


def test_small_files_are_whole_or_absent(spark, tmp_path):
    path = str(tmp_path / "folder" / "note")
    assert files.read_text(spark, path) is None and files.names(spark, str(tmp_path / "no")) == []
    files.write_text(spark, path, "one é")
    files.write_text(spark, path, "two é")
    assert files.read_text(spark, path) == "two é"
    tables.commit(spark, str(tmp_path / "c"), "b1", ["x"])
    tables.commit(spark, str(tmp_path / "c"), "b1", ["y"])
    assert [tuple(r) for r in tables.read_commits(spark, str(tmp_path / "c")).collect()] == [
        ("b1", ["x"])]


def test_only_the_named_batches_are_listed(spark, tmp_path):
    path = str(tmp_path / "layer")
    df = spark.sql("SELECT 'a' AS s, DATE'2026-01-01' AS snapshot_date")
    for n in range(5):
        tables.write_batch(df, path, f"b{n}")
    some = tables.read_some(spark, path, df.schema, ["b1", "b3", "none"])
    assert sorted(r["batch_id"] for r in some.collect()) == ["b1", "b3"]
    assert len(some.inputFiles()) == 2
    assert tables.read_some(spark, path, df.schema, []).count() == 0


def test_shuffle_partitions_follow_the_data():
    assert shuffle_partitions(1 << 20, 8) == 16
    assert shuffle_partitions(100 << 40, 8000) == 409_600
