"""Headline timings, one JSON line.

Each operator is timed on files prepared beforehand. Beside the compactions stands the pattern they
replace, written afresh here: for one partition after the other, read, `repartition(n)`, write; it checks
nothing, ours verify every row before the swap.
"""

from __future__ import annotations

import json
import os
import shutil
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import packwright as pw
from packwright import workloads as w

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
TABLES = ("events", "lineitem", "orders", "documents")
TARGET = 1 << 20


def session(shared: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("packwright-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )


def sequential_pattern(spark: SparkSession, base: str, out: str, target: int) -> None:
    """One `repartition(n)` job per partition directory, in sequence, unverified."""
    plan = pw.compaction_plan(pw.list_files(spark, base), target)
    for r in plan.orderBy("table_name", "partition").collect():
        place = f"{r.table_name}/{r.partition}".rstrip("/")
        rows = spark.read.parquet(f"{base}/{place}").repartition(r.n)
        rows.write.mode("overwrite").parquet(f"{out}/{place}")


def timed(prepare, work) -> float:
    """Median seconds of the work on freshly prepared input, after one run to warm up."""
    seconds = []
    for _ in range(REPEATS + 1):
        ready = prepare()
        start = time.perf_counter()
        work(ready)
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds[1:]), 3)


def main() -> None:
    shared = tempfile.mkdtemp(prefix="packwright-bench-")
    spark = session(shared)
    spark.sparkContext.setLogLevel("ERROR")
    names = iter(range(10_000))

    def new(kind: str) -> str:
        return f"{shared}/{kind}-{next(names)}"

    def database() -> str:
        base = new("db")
        for table in TABLES:
            w.scatter(spark, SF_DIR, table, f"{base}/{table}")
        return base

    kept = database()

    def copy_of_kept() -> str:
        return shutil.copytree(kept, new("db"))

    given = {t: w.given(spark, SF_DIR, t) for t in ("orders", "events", "lineitem")}
    sources = {fmt: new(fmt) for fmt in ("csv", "json", "parquet", "orc")}
    for fmt, path in sources.items():
        w.export(given["lineitem"], fmt, f"{path}/lineitem")

    def load(fmt: str, target: str) -> None:
        schema = given["lineitem"].schema
        pw.stage_load(spark, sources[fmt], "lineitem/", fmt, pw.PathTarget(target, schema))

    def stale() -> str:
        path = new("stage")
        given["orders"].write.parquet(path)
        return path

    queries = {
        "list_tables": timed(
            lambda: kept, lambda b: pw.list_tables(pw.list_files(spark, b)).collect()
        ),
        "list_partitions": timed(
            lambda: kept, lambda b: pw.list_partitions(pw.list_files(spark, b)).collect()
        ),
        "compaction_plan": timed(
            lambda: kept, lambda b: pw.compaction_plan(pw.list_files(spark, b), TARGET).collect()
        ),
        "compact_database": timed(
            copy_of_kept, lambda b: pw.compact_database(spark, b, target_bytes=TARGET)
        ),
        "compact_database_verify_rows": timed(
            copy_of_kept,
            lambda b: pw.compact_database(spark, b, target_bytes=TARGET, verify="rows"),
        ),
        "compact_table_by_day": timed(
            lambda: new("out"),
            lambda o: pw.compact_table(spark, f"{kept}/events", o, target_bytes=TARGET),
        ),
        "compact_flat_table": timed(
            lambda: new("out"),
            lambda o: pw.compact_table(spark, f"{kept}/orders", o, target_bytes=TARGET),
        ),
        "verify_compaction": timed(
            lambda: kept,
            lambda b: pw.verify_compaction(spark, f"{b}/lineitem", f"{b}/lineitem").collect(),
        ),
        **{
            f"stage_load_{fmt}": timed(stale, lambda target, fmt=fmt: load(fmt, target))
            for fmt in sources
        },
    }
    pattern = timed(
        lambda: new("pattern"), lambda out: sequential_pattern(spark, kept, out, TARGET)
    )
    rows = sum(w.given(spark, SF_DIR, t).count() for t in TABLES)
    report = pw.compact_database(spark, copy_of_kept(), target_bytes=TARGET)
    sizes = report.agg(
        *[F.sum(c).alias(c) for c in ("files_before", "files_after", "bytes_before", "bytes_after")]
    ).first()
    result = {
        "metric": "total seconds of the headline operators",
        "value": round(sum(queries.values()), 3),
        "unit": "sec",
        "queries": queries,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(CPUS),
        "sequential_pattern_sec": pattern,
        "compact_rows_per_sec": round(rows / queries["compact_database"]),
        "load_rows_per_sec": {
            fmt: round(given["lineitem"].count() / queries[f"stage_load_{fmt}"]) for fmt in sources
        },
        **sizes.asDict(),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
