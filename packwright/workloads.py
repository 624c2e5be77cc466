"""The registered queries: each splits given tables into the files an operator meets, runs it, and reads
the result back. Everything is sized from the tables, so the work grows with them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.operators.compact import compact_database, compact_partition, compact_table
from packwright.operators.promote import promote, promote_table
from packwright.operators.stage_load import stage_load
from packwright.operators.verify import verify_compaction
from packwright.plans.compaction import compaction_plan
from packwright.session import scratch_dir
from packwright.sinks.targets import PathTarget, TableTarget
from packwright.sources import files as inventory
from packwright.sources.parquet import read_table
from packwright.storage import Storage

# The plan query's target: small, so that the plan of small partitions is not all ones. The others' is fixed, too.
PLAN_TARGET = 1024
QUERY_TARGET = 1 << 20

DAY = "dt"
LINE_KEYS = ("l_returnflag", "l_linestatus")
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def given(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def given_bytes(spark: SparkSession, sf_dir: str, table: str) -> int:
    sizes = inventory.list_files(spark, sf_dir, [f"{table}.parquet"]).agg(F.sum("bytes").alias("b"))
    return sizes.first().b


def pieces(size: int) -> int:
    """How many writers make the many small files: 16, or one per 32 MiB of a larger table."""
    return max(16, -(-size // (32 << 20)))


def scatter(spark: SparkSession, sf_dir: str, table: str, out: str) -> int:
    """Write a given table as many small files: events by day, lineitem by two keys, others flat."""
    size = given_bytes(spark, sf_dir, table)
    rows = given(spark, sf_dir, table)
    keys: tuple[str, ...] = ()
    if table == "events":
        rows, keys = rows.withColumn(DAY, F.to_date("ts")), (DAY,)
    elif table == "lineitem":
        keys = LINE_KEYS
    writer = rows.repartition(pieces(size)).write
    (writer.partitionBy(*keys) if keys else writer).parquet(out)
    return QUERY_TARGET


def _split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of three given tables, split."""
    base = f"{scratch_dir(spark, 'query')}/db"
    for table in ("events", "lineitem", "orders"):
        scatter(spark, sf_dir, table, f"{base}/{table}")
    return inventory.list_files(spark, base)


def list_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.list_tables(_split_tables(spark, sf_dir))


def list_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.list_partitions(_split_tables(spark, sf_dir))


def _split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of events by day and lineitem by two keys, as lines of text: their sizes follow from the rows."""
    base = f"{scratch_dir(spark, 'query')}/db"
    events = given(spark, sf_dir, "events").withColumn(DAY, F.to_date("ts"))
    lines = {
        "events": (events, ("event_id", "user_id", "event_type"), (DAY,)),
        "lineitem": (given(spark, sf_dir, "lineitem"), ("l_orderkey", "l_partkey", "l_linenumber"), LINE_KEYS),
    }
    for table, (rows, columns, keys) in lines.items():
        text = rows.select(F.concat_ws(",", *columns).alias("value"), *keys)
        text.repartition(pieces(given_bytes(spark, sf_dir, table))).write.partitionBy(*keys).text(f"{base}/{table}")
    return inventory.list_files(spark, base)


def partition_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inventory.partition_size(_split_lines(spark, sf_dir)).select("table_name", "partition", "bytes")


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction_plan(_split_lines(spark, sf_dir), PLAN_TARGET).select("table_name", "partition", "bytes", "n")


def read_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"{scratch_dir(spark, 'query')}/events"
    scatter(spark, sf_dir, "events", table)
    return read_table(spark, table)


def compacted_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "query")
    target = scatter(spark, sf_dir, "documents", f"{root}/documents/20240101")
    out = f"{root}/out"
    compact_partition(spark, f"{root}/documents/20240101", out, target_bytes=target)
    return spark.read.parquet(out)


def compacted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "query")
    target = scatter(spark, sf_dir, "events", f"{root}/events")
    compact_table(spark, f"{root}/events", f"{root}/out", target_bytes=target)
    return spark.read.parquet(f"{root}/out").withColumn(DAY, F.col(DAY).cast("date"))


def compacted_nested_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "query")
    target = scatter(spark, sf_dir, "lineitem", f"{root}/lineitem")
    compact_table(spark, f"{root}/lineitem", f"{root}/out", target_bytes=target)
    return spark.read.parquet(f"{root}/out").select(given(spark, sf_dir, "lineitem").columns)


def compacted_flat_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "query")
    target = scatter(spark, sf_dir, "orders", f"{root}/orders")
    compact_table(spark, f"{root}/orders", f"{root}/out", target_bytes=target)
    return spark.read.parquet(f"{root}/out")


def compacted_opaque_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in directories named `20240101`, which partition discovery does not see."""
    root = scratch_dir(spark, "query")
    target = scatter(spark, sf_dir, "events", f"{root}/by_day")
    storage = Storage(spark, root)
    storage.mkdirs(f"{root}/events")
    for name in storage.child_dirs(f"{root}/by_day"):
        plain = name.removeprefix(f"{DAY}=").replace("-", "")
        storage.rename(f"{root}/by_day/{name}", f"{root}/events/{plain}")
    compact_table(spark, f"{root}/events", f"{root}/out", target_bytes=target)
    return read_table(spark, f"{root}/out")


def compacted_database(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{scratch_dir(spark, 'query')}/db"
    tables = ("events", "orders", "customer")
    targets = [scatter(spark, sf_dir, table, f"{base}/{table}") for table in tables]
    report = compact_database(spark, base, target_bytes=min(targets))
    return report.groupBy("table_name").agg(
        F.sum("rows_before").alias("rows_before"), F.sum("rows_after").alias("rows_after")
    )


def verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_dir(spark, "query")
    target = scatter(spark, sf_dir, "events", f"{root}/events")
    compact_table(spark, f"{root}/events", f"{root}/out", target_bytes=target)
    report = verify_compaction(spark, f"{root}/events", f"{root}/out")
    return report.select("partition", "rows_before", "rows_after", "equal")


def promoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{scratch_dir(spark, 'query')}/db"
    target = scatter(spark, sf_dir, "customer", f"{base}/customer")
    compact_table(spark, f"{base}/customer", f"{base}_bkup/customer", target_bytes=target)
    promote(spark, base)
    return spark.read.parquet(f"{base}/customer")


def promoted_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a catalog table, partitioned by nation, compacted beside its files and pointed there."""
    root = scratch_dir(spark, "query")
    rows = given(spark, sf_dir, "customer")
    columns = [c for c in rows.columns if c != "c_nationkey"] + ["c_nationkey"]
    rows.select(columns).repartition(pieces(given_bytes(spark, sf_dir, "customer"))).write.partitionBy("c_nationkey").parquet(f"{root}/customer")
    name = f"customer_{uuid.uuid4().hex}"
    ddl = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    spark.sql(f"CREATE TABLE {name} ({ddl}) USING parquet PARTITIONED BY (c_nationkey) LOCATION '{root}/customer'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    compact_table(spark, f"{root}/customer", f"{root}/out", target_bytes=QUERY_TARGET)
    promote_table(spark, name, f"{root}/out")
    return spark.table(name)


def load_into_path(
    spark: SparkSession, sf_dir: str, table: str, file_format: str, renamed: bool = False
) -> DataFrame:
    """Export a table as load source, fill the target with its rows twice over, load, read the target."""
    root = scratch_dir(spark, "query")
    rows = given(spark, sf_dir, table)
    if renamed:  # other names, and in half of the files the same names in another order: places count
        names = [f"c{i}" for i in range(len(rows.columns))]
        half = F.xxhash64(*rows.columns) % 2 == 0
        export(rows.where(half).toDF(*names), file_format, f"{root}/source/{table}/a")
        export(rows.where(~half).toDF(*reversed(names)), file_format, f"{root}/source/{table}/b")
    else:
        export(rows, file_format, f"{root}/source/{table}")
    rows.unionAll(rows).write.parquet(f"{root}/stage")
    target = PathTarget(f"{root}/stage", rows.schema)
    stage_load(spark, f"{root}/source", f"{table}/", file_format, target)
    return spark.read.parquet(f"{root}/stage")


def export(rows: DataFrame, file_format: str, path: str) -> None:
    writer = rows.write.format(file_format)
    if file_format == "csv":
        writer = writer.option("escape", '"')
    if file_format in ("csv", "json"):
        writer = writer.option("timestampNTZFormat", MICROS)
    writer.save(path)


def load_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as CSV with line breaks inside quotes, some texts empty and some missing."""
    root = scratch_dir(spark, "query")
    text = F.when(F.col("doc_id") % 10 == 0, F.lit("")).when(F.col("doc_id") % 10 != 1, F.col("text"))
    rows = given(spark, sf_dir, "documents").withColumn("text", text)
    export(rows, "csv", f"{root}/source/documents")
    target = PathTarget(f"{root}/stage", rows.schema)
    stage_load(spark, f"{root}/source", "documents/", "csv", target, {"multi_line": "true"})
    return spark.read.parquet(f"{root}/stage")


def load_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitem under keys that start with `load_`, beside other files that must stay out."""
    root = scratch_dir(spark, "query")
    rows = given(spark, sf_dir, "lineitem")
    export(rows, "csv", f"{root}/source/load_lineitem/day")
    export(given(spark, sf_dir, "supplier"), "csv", f"{root}/source/other_supplier")
    target = PathTarget(f"{root}/stage", rows.schema)
    stage_load(spark, f"{root}/source", "load_", "csv", target)
    return spark.read.parquet(f"{root}/stage")


def load_into_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers into a catalog table, partitioned by nation, that holds other rows."""
    root = scratch_dir(spark, "query")
    rows = given(spark, sf_dir, "customer")
    export(rows, "json", f"{root}/source/customer")
    name = f"stage_customer_{uuid.uuid4().hex}"
    columns = [c for c in rows.columns if c != "c_nationkey"] + ["c_nationkey"]
    ddl = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns)
    spark.sql(
        f"CREATE TABLE {name} ({ddl}) USING parquet PARTITIONED BY (c_nationkey) "
        f"LOCATION '{root}/stage'"
    )
    rows.select(columns).write.insertInto(name)
    stage_load(spark, f"{root}/source", "customer/", "json", TableTarget(name))
    return spark.table(name)
