"""Replace all rows of a staging table by the files under a key prefix."""

from __future__ import annotations

from pyspark.sql import SparkSession

from packwright.errors import MaintenanceError, PromotionError, ReplacementError
from packwright.session import LOAD_SETTINGS, settings
from packwright.sinks.targets import JdbcTarget, PathTarget, TableTarget, staged_rows
from packwright.sources.formats import read_prefix
from packwright.storage import Storage


def stage_load(
    spark: SparkSession,
    root: str,
    prefix: str,
    file_format: str,
    target: PathTarget | TableTarget | JdbcTarget,
    options: dict[str, str] | None = None,
) -> int:
    """Load `root/prefix*` into `target` and return the number of rows loaded.

    Every record is decoded into a copy first; the old rows are replaced only when all of them fit. A bad
    record, a missing prefix or a NULL where none is allowed leaves the target as it was. So does every failure
    but a `ReplacementError`: that one came while the old rows were being replaced.
    """
    schema = target.schema_in(spark)
    staged = target.staging(spark)
    storage = Storage(spark, staged)
    if storage.qualified(staged).startswith(f"{Storage(spark, root).qualified(root).rstrip('/')}/{prefix}"):
        raise MaintenanceError(f"{root}/{prefix}* covers the target's own files at {staged}")
    if storage.exists(staged):
        raise MaintenanceError(f"{staged} is left from an earlier run; look at it, then remove it")
    with settings(spark, LOAD_SETTINGS):
        try:
            rows = read_prefix(spark, root, prefix, file_format, schema, options)
            rows.write.mode("errorifexists").parquet(staged)
            loaded = staged_rows(spark, schema, staged).count()
        except Exception:
            storage.delete(staged)
            raise
        try:
            target.rehearse(spark, staged)
            try:
                target.replace(spark, staged)
            except PromotionError:  # undone
                raise
            except Exception as failure:
                raise ReplacementError(f"the old rows may be gone; the decoded rows are at {staged}") from failure
        except ReplacementError:
            raise
        except Exception as failure:
            raise MaintenanceError(f"the old rows are untouched; the decoded rows are at {staged}") from failure
        storage.delete(staged)
    return loaded
