"""Inventory of a database directory: `<base>/<table>/<partition>/.../<file>`.

The listing is a `binaryFile` scan without its `content` column, so no file is read. Names come from the
file system as they are; `key=value` is not parsed, any depth and any naming is taken. Empty directories
hold no rows and do not appear.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.functions.columns import below, file_uri, parent
from packwright.storage import Storage, literal, normalise


def list_files(spark: SparkSession, base: str, tables: Iterable[str] | None = None) -> DataFrame:
    """One row per visible file: table_name, partition, path, uri, leaf_uri, bytes, modified.

    `partition` is the directory below the table, empty for files in the table's own directory.
    `leaf_uri` is the same directory as `_metadata.file_path` spells it. No task opens a file, so there are as many
    tasks as the cluster has cores, whatever the files weigh.
    """
    storage = Storage(spark, normalise(base))
    root = storage.qualified(normalise(base))
    roots = [root] if tables is None else [f"{root}/{table}" for table in tables]
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load([literal(r) for r in roots])
    )
    relative = below(F.col("path"), root)
    table = F.substring_index(relative, "/", 1)
    name = F.substring_index(relative, "/", -1)
    depth = F.length(relative) - F.length(table) - F.length(name) - 2
    uri = file_uri(listing)
    return listing.select(
        table.alias("table_name"),
        F.substring(relative, F.length(table) + 2, depth).alias("partition"),
        F.col("path"),
        uri.alias("uri"),
        parent(uri).alias("leaf_uri"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    ).coalesce(max(1, spark.sparkContext.defaultParallelism))


def list_tables(files: DataFrame) -> DataFrame:
    """Direct children of the base."""
    return files.select("table_name").distinct()


def list_partitions(files: DataFrame) -> DataFrame:
    """Directories that hold files, per table."""
    return files.select("table_name", "partition").distinct()


def partition_size(files: DataFrame, by: Iterable[str] = ("table_name", "partition")) -> DataFrame:
    """File count and bytes per partition (or per table)."""
    return files.groupBy(*by).agg(
        F.count("*").alias("n_files"), F.sum("bytes").cast("bigint").alias("bytes")
    )
