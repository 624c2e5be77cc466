"""Parquet scans that keep rows and names exactly as the files have them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright.functions.columns import below, file_uri, parent
from packwright.storage import Storage, literal, normalise


def read_files(
    spark: SparkSession, *paths: str, schema: T.StructType | None = None
) -> DataFrame:
    """Every file below some directories, by file and without partition discovery.

    Discovery would skip opaque directories beside root files and would retype values such as `01`.
    Schemas are merged, so that a column only some files have is kept; types that do not merge raise. A
    corrupt or missing file stops the scan whatever the session says, also where it runs later.
    """
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false")
    reader = reader.option("mergeSchema", "true") if schema is None else reader.schema(schema)
    return reader.parquet(*[literal(path) for path in paths])


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """The rows of one partition directory; partition columns of the table are not added."""
    return read_files(spark, normalise(path))


def read_table(spark: SparkSession, path: str, partition_column: str = "partition") -> DataFrame:
    """All rows of a table, each with the name of the directory that holds it."""
    table = normalise(path)
    scan = read_files(spark, table)
    root = Storage(spark, table).uri(table)
    return scan.select(
        *[F.col("`" + c.replace("`", "``") + "`") for c in scan.columns],
        F.url_decode(
            F.replace(below(parent(file_uri(scan)), root), F.lit("+"), F.lit("%2B"))
        ).alias(partition_column),
    )
