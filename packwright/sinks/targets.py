"""Where a staging load goes. Each target keeps its definition and replaces all of its rows."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from packwright.errors import MaintenanceError
from packwright.operators.promote import promote, refresh_readers
from packwright.session import scratch_dir
from packwright.sources.formats import checked_identifier
from packwright.storage import Storage, normalise

# Name beside a target directory under which a load is prepared.
LOAD_SUFFIX = "_load"


def staged_rows(spark: SparkSession, target_schema: T.StructType, staged: str) -> DataFrame:
    return spark.read.schema(target_schema).parquet(staged)


@dataclass(frozen=True)
class PathTarget:
    """A directory of Parquet files. The decoded copy becomes the directory: rows are written once."""

    path: str
    schema: T.StructType

    def schema_in(self, spark: SparkSession) -> T.StructType:
        return self.schema

    def staging(self, spark: SparkSession) -> str:
        return normalise(self.path) + LOAD_SUFFIX

    def rehearse(self, spark: SparkSession, staged: str) -> None:
        """Nothing to try out: the copy itself becomes the target."""

    def replace(self, spark: SparkSession, staged: str) -> None:
        path = normalise(self.path)
        storage = Storage(spark, path)
        if storage.exists(path):
            promote(spark, path, staged, late_files=False)
        else:
            storage.rename(staged, path)
            refresh_readers(spark, path, ())


@dataclass(frozen=True)
class TableTarget:
    """A catalog table. The checked copy is inserted over its rows, so any provider or layout will do.

    Rows of a partitioned table are brought together by partition first, in parts of even size however
    the rows are spread, or every task would leave a small file in every partition.
    """

    table: str

    def schema_in(self, spark: SparkSession) -> T.StructType:
        return spark.table(checked_identifier(self.table)).schema

    def staging(self, spark: SparkSession) -> str:
        return f"{scratch_dir(spark, 'load')}/rows"

    def replace(self, spark: SparkSession, staged: str) -> None:
        rows = staged_rows(spark, self.schema_in(spark), staged)
        columns = spark.catalog.listColumns(checked_identifier(self.table))
        keys = [c.name for c in columns if c.isPartition]
        placed = rows.hint("rebalance", *keys) if keys else rows
        placed.write.insertInto(self.table, overwrite=True)
        _require_count(spark.table(self.table).count(), rows.count(), self.table)

    def rehearse(self, spark: SparkSession, staged: str) -> None:
        """Insert into an empty table of the same definition and provider first: what the store refuses (a text too
        long for its column, say) must show before the old rows go."""
        name, place = f"rehearsal_{uuid.uuid4().hex}", f"{staged}_rehearsal"
        spark.sql(f"CREATE TABLE {name} LIKE {checked_identifier(self.table)} LOCATION '{place}'")
        try:
            staged_rows(spark, self.schema_in(spark), staged).write.insertInto(name)
        finally:
            spark.sql(f"DROP TABLE {name}")
            Storage(spark, place).delete(place)


@dataclass(frozen=True)
class JdbcTarget:
    """A table of a database. It is truncated, not dropped, so its definition stays.

    `connections` bounds the tasks that write at a time. A task that is run again after its commit would
    store its rows twice: the rows are counted afterwards.
    """

    url: str
    table: str
    properties: dict[str, str] = field(default_factory=dict, repr=False)
    connections: int = 16

    def schema_in(self, spark: SparkSession) -> T.StructType:
        return self._table(spark).schema

    def staging(self, spark: SparkSession) -> str:
        return f"{scratch_dir(spark, 'load')}/rows"

    def rehearse(self, spark: SparkSession, staged: str) -> None:
        """A database has no cheap twin of a table: its types were matched when the rows were decoded."""

    def replace(self, spark: SparkSession, staged: str) -> None:
        rows = staged_rows(spark, self.schema_in(spark), staged)
        self._writer(rows).jdbc(self.url, checked_identifier(self.table), properties=self.properties)
        _require_count(self._table(spark).count(), rows.count(), self.table)

    def _table(self, spark: SparkSession) -> DataFrame:
        return spark.read.jdbc(self.url, checked_identifier(self.table), properties=self.properties)

    def _writer(self, rows: DataFrame):
        options = {"truncate": "true", "numPartitions": self.connections, "batchsize": 10000}
        return rows.write.mode("overwrite").options(**options)


def _require_count(stored: int, expected: int, table: str) -> None:
    if stored != expected:
        raise MaintenanceError(f"{table} has {stored} rows after the load, not {expected}: load again")
