"""What a job needs from the caller's session: a shared scratch folder and a few settings."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from packwright.errors import MaintenanceError

# Settings every compaction or load runs under. Corrupt or missing files must stop the job, or both
# sides of the row check would skip the same rows. The writer setting lets a task that holds several
# small partitions keep a file open for each instead of sorting all its rows first.
JOB_SETTINGS = {
    "spark.sql.files.ignoreCorruptFiles": "false",
    "spark.sql.files.ignoreMissingFiles": "false",
    "spark.sql.maxConcurrentOutputFileWriters": "64",
}

# A load, besides, must stop at a number that does not fit its column, and replace every partition.
LOAD_SETTINGS = {
    **JOB_SETTINGS,
    "spark.sql.sources.partitionOverwriteMode": "static",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.storeAssignmentPolicy": "ANSI",
}

# A listing reads no file content, so splits are packed by core count and not by file size.
LISTING_SETTINGS = {"spark.sql.files.maxPartitionBytes": str(1 << 50)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Set session values for the duration of a block, then put the caller's values back."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder under `spark.checkpoint.dir`; a machine-local one only for a local session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise MaintenanceError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"packwright-{purpose}-")
    return f"{root.rstrip('/')}/packwright-{purpose}-{uuid.uuid4().hex}"


def freeze(df: DataFrame, path: str) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back, so that it is computed once."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
