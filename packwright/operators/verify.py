"""Compare two directory trees row by row, by partition, without moving any row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright.errors import MaintenanceError
from packwright.functions.columns import below, file_uri, parent
from packwright.functions.fingerprint import combined_sum, hash_sums, row_hash
from packwright.sources.files import list_files
from packwright.sources.parquet import read_files
from packwright.storage import Storage, normalise

LEVELS = ("full", "rows")


def leaf_digest(scan: DataFrame, level: str = "full") -> DataFrame:
    """Rows and fingerprint per directory: leaf_uri, rows, fingerprint.

    Both are summed before the shuffle, so one partition may hold any share of the rows. Level `rows`
    reads no column: the row counts come from the file footers.
    """
    if level not in LEVELS:
        raise MaintenanceError(f"verify must be one of {LEVELS}: {level!r}")
    uri = file_uri(scan).alias("uri")
    if level == "rows":
        files = scan.select(uri).groupBy("uri").agg(F.count("*").alias("rows"))
        return _by_leaf(files).withColumn("fingerprint", F.lit(""))
    hashed = scan.select(uri, row_hash(scan.schema).alias("row_hash"))
    files = hashed.groupBy("uri").agg(F.count("*").alias("rows"), *hash_sums("row_hash"))
    return _by_leaf(files).select("leaf_uri", "rows", combined_sum().alias("fingerprint"))


def _by_leaf(files: DataFrame) -> DataFrame:
    """Sums per file to sums per directory: the directory is cut out once per file, not once per row."""
    facts = [c for c in files.columns if c != "uri"]
    leaf = parent(F.col("uri")).alias("leaf_uri")
    return files.groupBy(leaf).agg(*[F.sum(c).alias(c) for c in facts])


def tagged(side: str, frame: DataFrame, root: str) -> DataFrame:
    """Facts about directories below `root` as one side, `before` or `after`, of a comparison.

    `frame` has leaf_uri and any of files, bytes, rows, fingerprint, partition and files_planned; a
    directory may have several rows.
    """
    facts = [c for c in ("files", "bytes", "rows", "fingerprint") if c in frame.columns]
    names = [c for c in ("partition", "files_planned") if c in frame.columns]
    leaf = below(F.col("leaf_uri"), root).alias("leaf")
    return frame.select(leaf, *names, *[F.col(c).alias(f"{c}_{side}") for c in facts])


def compare_leaves(*facts: DataFrame) -> DataFrame:
    """Put all facts together by directory: counts of both sides, and whether their rows are equal.

    One grouping, of as many rows as there are directories and files.
    """
    together = facts[0]
    for more in facts[1:]:
        together = together.unionByName(more, allowMissingColumns=True)
    sums = [f"{c}_{side}" for c in ("files", "bytes", "rows") for side in ("before", "after")]
    texts = ["fingerprint_before", "fingerprint_after"]
    extra = [c for c in ("partition", "files_planned") if c in together.columns]
    grouped = together.groupBy("leaf").agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in sums],
        *[F.max(c).alias(c) for c in (*texts, *extra)],
    )
    same = (
        F.col("leaf").isNotNull()
        & (F.col("files_before") > 0)
        & (F.col("files_after") > 0)
        & (F.col("rows_before") == F.col("rows_after"))
        & F.col("fingerprint_before").eqNullSafe(F.col("fingerprint_after"))
    )
    return grouped.select("leaf", *extra, *sums, same.alias("equal"))


def tree_facts(
    spark: SparkSession, side: str, path: str, schema: T.StructType | None, level: str
) -> list[DataFrame]:
    """Files and bytes, and rows and fingerprints, of the directories below a table."""
    parent_path, name = path.rsplit("/", 1)
    root = Storage(spark, path).uri(path)
    files = list_files(spark, parent_path, [name])
    sizes = files.select("leaf_uri", F.lit(1).cast("bigint").alias("files"), "bytes")
    digest = leaf_digest(read_files(spark, path, schema=schema), level)
    return [tagged(side, sizes, root), tagged(side, digest, root)]


def verify_compaction(
    spark: SparkSession, before: str, after: str, level: str = "full"
) -> DataFrame:
    """Per partition of two copies of a table: files, bytes and rows of both, and whether they are equal.

    `partition` is the percent-encoded directory below the table. Both sides are read with the merged
    schema of the first, column by column in that order; a copy that lacks or adds a column is refused.
    """
    schema = read_files(spark, normalise(before)).schema
    other = read_files(spark, normalise(after)).schema
    if _names_and_types(schema) != _names_and_types(other):
        raise MaintenanceError(f"{before} and {after} have different columns")
    facts = [
        *tree_facts(spark, "before", normalise(before), schema, level),
        *tree_facts(spark, "after", normalise(after), schema, level),
    ]
    return compare_leaves(*facts).withColumnRenamed("leaf", "partition")


def _names_and_types(schema: T.StructType) -> list[tuple[str, str]]:
    return sorted((f.name, f.dataType.simpleString()) for f in schema.fields)
