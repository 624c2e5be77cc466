"""Keep file-based tables healthy with Spark: inventory, compaction, checked swap, staging load."""

from packwright.operators.compact import compact_catalog_table, compact_database, compact_partition, compact_table
from packwright.operators.promote import map_path, promote, promote_table, recover
from packwright.operators.stage_load import stage_load
from packwright.operators.verify import verify_compaction
from packwright.plans.compaction import TARGET_BYTES, compaction_plan, output_files
from packwright.sinks.targets import JdbcTarget, PathTarget, TableTarget
from packwright.sources.files import list_files, list_partitions, list_tables, partition_size
from packwright.sources.parquet import read_partition, read_table

__all__ = [
    "JdbcTarget",
    "PathTarget",
    "TARGET_BYTES",
    "TableTarget",
    "compact_catalog_table",
    "compact_database",
    "compact_partition",
    "compact_table",
    "compaction_plan",
    "list_files",
    "list_partitions",
    "list_tables",
    "map_path",
    "output_files",
    "partition_size",
    "promote",
    "promote_table",
    "read_partition",
    "read_table",
    "recover",
    "stage_load",
    "verify_compaction",
]
