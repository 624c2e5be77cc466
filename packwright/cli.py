"""Command line: `spark-submit packwright_job.py compact -p <base>` and `... load ...`."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from packwright.operators.compact import compact_catalog_table, compact_database
from packwright.operators.promote import promote_table, recover
from packwright.operators.stage_load import stage_load
from packwright.plans.compaction import TARGET_BYTES
from packwright.sinks.targets import JdbcTarget, PathTarget, TableTarget
from packwright.sources.formats import FORMATS


def _pairs(values: list[str]) -> dict[str, str]:
    return dict(value.split("=", 1) for value in values)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="packwright")
    top.add_argument("--no-hive", action="store_true", help="do without the Hive catalog")
    commands = top.add_subparsers(dest="command", required=True)

    compact = commands.add_parser("compact", help="compact every table below a directory")
    compact.add_argument("--basepath", "-p", required=True)
    compact.add_argument("--table", action="append", help="only this table; may be repeated")
    compact.add_argument("--target-bytes", type=int, default=TARGET_BYTES)
    compact.add_argument("--only-if-files-exceed-plan", action="store_true")
    compact.add_argument("--verify", choices=("full", "rows"), default="full")
    compact.add_argument("--codec")
    compact.add_argument("--no-swap", action="store_true", help="leave the copy at <base>_bkup")
    compact.add_argument("--concurrency", type=int, default=4, help="tables worked on at a time")
    compact.add_argument("--refresh", action="append", default=[], help="catalog table to refresh")

    catalog = commands.add_parser("compact-table", help="compact a catalog table into a new directory, point it there")
    catalog.add_argument("--table", required=True)
    catalog.add_argument("--out", required=True, help="new directory")
    catalog.add_argument("--target-bytes", type=int, default=TARGET_BYTES)

    point = commands.add_parser("promote-table", help="point a catalog table at a checked copy")
    point.add_argument("--table", required=True)
    point.add_argument("--path", required=True, help="directory of the copy")
    point.add_argument("--verify", choices=("full", "rows"), default="full")

    again = commands.add_parser("recover", help="take a swap that was cut off back, or on to its end")
    again.add_argument("--basepath", "-p", required=True)
    again.add_argument("--forward", action="store_true")

    load = commands.add_parser("load", help="replace a staging table by files under a prefix")
    load.add_argument("--root", required=True, help="directory or bucket")
    load.add_argument("--prefix", required=True, help="leading text of the keys")
    load.add_argument("--format", choices=sorted(FORMATS), required=True)
    target = load.add_mutually_exclusive_group(required=True)
    target.add_argument("--table", help="catalog table")
    target.add_argument("--path", help="directory of Parquet files; needs --schema")
    target.add_argument("--jdbc-table", help="database table; needs --jdbc-url")
    load.add_argument("--schema", help="columns and types, as in CREATE TABLE")
    load.add_argument("--jdbc-url")
    load.add_argument("--jdbc-property", action="append", default=[], metavar="KEY=VALUE")
    load.add_argument("--option", action="append", default=[], metavar="KEY=VALUE")
    load.add_argument("--jdbc-properties", help="file of KEY=VALUE lines: the place for passwords")
    load.add_argument("--options-file", help="file of KEY=VALUE lines: the place for access keys")
    return top


# Words in the name of a setting whose value must not stand on a command line, where every user can read it.
_SECRET = ("password", "secret", "token", "access.key", "sessioncredential")


def settings_of(values: list[str], path: str | None) -> dict[str, str]:
    """Settings from the command line, and from a file of `key=value` lines (`#` begins a comment)."""
    shown = sorted(k for k in _pairs(values) if any(word in k.lower() for word in _SECRET))
    if shown:
        raise SystemExit(f"put {shown} into a file, not on the command line")
    lines = []
    if path:
        with open(path, encoding="utf-8") as f:
            lines = [line.strip() for line in f if line.strip() and not line.strip().startswith("#")]
    return {**_pairs(values), **_pairs(lines)}


def target_of(args: argparse.Namespace) -> PathTarget | TableTarget | JdbcTarget:
    if args.table:
        return TableTarget(args.table)
    if args.path:
        if not args.schema:
            raise SystemExit("--path needs --schema")
        return PathTarget(args.path, T.StructType.fromDDL(args.schema))
    if not args.jdbc_url:
        raise SystemExit("--jdbc-table needs --jdbc-url")
    return JdbcTarget(args.jdbc_url, args.jdbc_table, settings_of(args.jdbc_property, args.jdbc_properties))


def run(spark: SparkSession, argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    if args.command == "compact":
        report = compact_database(
            spark,
            args.basepath,
            tables=args.table,
            swap_in=not args.no_swap,
            concurrency=args.concurrency,
            refresh=args.refresh,
            target_bytes=args.target_bytes,
            verify=args.verify,
            only_if_files_exceed_plan=args.only_if_files_exceed_plan,
            codec=args.codec,
        )
        totals = report.selectExpr(
            "count(*) AS partitions",
            "sum(files_before) AS files_before",
            "sum(files_after) AS files_after",
            "sum(bytes_before) AS bytes_before",
            "sum(bytes_after) AS bytes_after",
            "sum(rows_after) AS rows",
        )
        print(totals.first().asDict())
    elif args.command == "compact-table":
        report = compact_catalog_table(spark, args.table, args.out, target_bytes=args.target_bytes)
        print(report.selectExpr("count(*) AS partitions", "sum(files_before) AS files_before", "sum(files_after) AS files_after").first().asDict())
    elif args.command == "promote-table":
        print({"old": promote_table(spark, args.table, args.path, args.verify)})
    elif args.command == "recover":
        print({"changed": recover(spark, args.basepath, args.forward)})
    else:
        rows = stage_load(
            spark, args.root, args.prefix, args.format, target_of(args), settings_of(args.option, args.options_file)
        )
        print({"rows": rows})


def main() -> None:
    builder = SparkSession.builder.appName("packwright")
    if not parser().parse_args().no_hive:
        builder = builder.enableHiveSupport()
    run(builder.getOrCreate())
