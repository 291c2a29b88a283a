"""Command line: ``spark-submit`` (or ``python -m``) ``tidemark <command> ...``.

Any failure ends with a non-zero exit code.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import dedup, nested, quality, reports
from tidemark.operators.history import Timeline, find_cut_points
from tidemark.plans import jobs
from tidemark.plans.jobs import Layers
from tidemark.plans.layers import rebased
from tidemark.session import AT_SCALE, apply_semantics, shuffle_partitions
from tidemark.sources.schemas import COIN, GOLD, SILVER_KEY, STATUS, further_fields
from tidemark.sources.tables import export_csv
from tidemark.streaming.jobs import latest_date, latest_gold, start_all

def _latest(report):
    return lambda spark, layers, args: report(
        latest_gold(spark, layers), date="snapshot_date", on=latest_date(spark, layers))


def _rebased(spark, layers, args):
    silver = layers.read_silver(spark)
    return rebased(silver, cuts=find_cut_points(silver, Timeline())).select(
        "symbol", "collected_at", "rebased")


def _of_gold(report):
    return lambda spark, layers, args: report(latest_gold(spark, layers))


def _history(spark, layers, args):
    if args.symbol is None:
        raise SystemExit("name a --symbol")
    return reports.key_history(latest_gold(spark, layers), args.symbol, GOLD.names)


REPORTS = {
    "movers": _latest(reports.latest_movers),
    "volatility": _latest(reports.latest_volatility),
    "dominance": _latest(reports.latest_dominance),
    "overview": _of_gold(reports.data_overview),
    "times": _of_gold(reports.snapshot_times),
    "history": _history,
    "rebased": _rebased,
    "summary": lambda spark, layers, args: jobs.overview(spark, layers),
    "undeclared": lambda spark, layers, args: nested.undeclared_fields(
        layers.read_bronze(spark), "raw_json", COIN.names),
    "profile": lambda spark, layers, args: reports.table_profile(layers.read(spark, args.layer)),
    "nulls": lambda spark, layers, args: quality.null_profile(layers.read(spark, args.layer)),
    "new-columns": lambda spark, layers, args: reports.new_columns(
        latest_gold(spark, layers), layers.read_silver(spark)),
    "duplicates": lambda spark, layers, args: dedup.duplicate_keys(
        layers.read(spark, args.layer), SILVER_KEY),
    **{
        f"silver-{table}": lambda spark, layers, args, table=table: layers.read_notes(spark, table)
        for table in jobs.NOTES
    },
}


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        added = commands.add_parser(name, help=text)
        added.add_argument("--root", required=True, help="folder of the layers")
        added.add_argument("--shuffle-gb", type=int, help="size of the largest shuffle")
        return added

    cycle = command("cycle", "landing files through Bronze and Silver to a new Gold")
    cycle.add_argument("--batch-id", required=True)
    stream = command("stream", "poll the landing folder until stopped")
    stream.add_argument("--every", default="4 hours")
    for taker, mode in ((cycle, "fail"), (stream, "quarantine")):
        taker.add_argument("--landing", required=True)
        taker.add_argument("--endpoint", required=True, help="origin to note in the audit")
        taker.add_argument("--mode", choices=jobs.MODES, default=mode)
        taker.add_argument("--lines", action="store_true", help="one payload per line")
        taker.add_argument("--max-rank", type=int, help="fail greater ranks; no bound if absent")
        taker.add_argument("--more-coin", help="further listing fields, as 'name TYPE, ...'")
        taker.add_argument("--more-status", help="further status fields, as 'name TYPE, ...'")
    rebuild = command("rebuild", "Gold from all of Silver")
    rebuild.add_argument("--more-coin", help="further listing fields Silver was written with")
    compact = command("compact", "merge the batches of a layer into tables by date")
    compact.add_argument("--layer", choices=["bronze", "audit", "silver", "live_gold"],
                         default="silver")
    compact.add_argument("--more-coin", help="further listing fields the layer was written with")
    load = command("import", "listings kept as CSV into Bronze and Silver")
    load.add_argument("--batch-id", required=True)
    load.add_argument("--csv", required=True, action="append", help="files of one layout each")
    load.add_argument("--mode", choices=jobs.MODES, default="fail")
    load.add_argument("--max-rank", type=int, help="fail greater ranks; no bound if absent")
    export = command("export", "a layer as a folder of CSV files")
    export.add_argument("layer", choices=["bronze", "audit", "silver", "gold"])
    export.add_argument("--to", required=True)
    report = command("report", "a report on the stored layers")
    report.add_argument("name", choices=sorted(REPORTS))
    report.add_argument("--layer", choices=["bronze", "audit", "silver", "gold"], default="silver",
                        help="what profile, nulls and duplicates are of")
    report.add_argument("--symbol", help="whose history")
    out = report.add_mutually_exclusive_group(required=True)
    out.add_argument("--rows", type=int, help="print the first so many rows")
    out.add_argument("--to", help="write the whole report as a folder of CSV files")
    return parser


def _wider(schema: T.StructType, more: str | None) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(more).fields]) if more else schema


def main() -> None:
    args = arguments().parse_args()
    builder = SparkSession.builder.appName(f"tidemark {args.command}")
    for name, value in AT_SCALE.items():
        builder = builder.config(name, value)
    spark = apply_semantics(builder.getOrCreate())
    if args.shuffle_gb is not None:
        cores = spark.sparkContext.defaultParallelism
        partitions = shuffle_partitions(args.shuffle_gb << 30, cores)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    layers = Layers(args.root)
    if args.command == "cycle":
        jobs.run_cycle(
            spark, args.landing, layers, args.batch_id, args.endpoint, args.mode,
            not args.lines, args.max_rank, _wider(COIN, args.more_coin),
            _wider(STATUS, args.more_status),
        ).show(truncate=False)
    elif args.command == "stream":
        start_all(
            spark, args.landing, layers, args.endpoint, args.every, args.mode,
            not args.lines, args.max_rank, _wider(COIN, args.more_coin),
            _wider(STATUS, args.more_status),
        )
        spark.streams.awaitAnyTermination()
    elif args.command == "rebuild":
        jobs.rebuild_gold(spark, layers, more=further_fields(_wider(COIN, args.more_coin)))
    elif args.command == "compact":
        more = further_fields(_wider(COIN, args.more_coin))
        jobs.compact(spark, layers, args.layer, more)
    elif args.command == "import":
        jobs.import_bronze(spark, args.csv, layers, args.batch_id)
        bronze = layers.read_bronze(spark).filter(F.col("batch_id") == args.batch_id)
        jobs.write_silver(bronze, layers, args.batch_id, args.mode, args.max_rank)
    elif args.command == "export":
        export_csv(layers.read(spark, args.layer), args.to)
    else:
        rows = REPORTS[args.name](spark, layers, args)
        if args.to:
            export_csv(rows, args.to)
        else:
            rows.show(args.rows, truncate=False)


if __name__ == "__main__":
    main()
