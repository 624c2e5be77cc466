"""Column expressions on file paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A file's place is a hash of 63 bits: a partition that is cut into several jobs is cut by places.
PLACE_BITS = 63
LAST_PLACE = (1 << PLACE_BITS) - 1


def named(name: str) -> Column:
    """A top-level column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def file_uri(df: DataFrame) -> Column:
    """The file a row was read from; works also where the data has a column called `_metadata`."""
    return df.metadataColumn("_metadata").getField("file_path")


def parent(path: Column) -> Column:
    """The directory part of a path. Cut by bytes: this runs for every row, and counting letters is slow."""
    name = F.substring_index(path, "/", -1)
    size = F.octet_length(path) - F.octet_length(name) - 1
    return F.substring(path.cast("binary"), F.lit(1), size).cast("string")


def below(path: Column, root: str) -> Column:
    """What follows `root/` in a path, empty for the root itself, NULL for a path that lies elsewhere."""
    rest = F.substring(path, len(root) + 2, 1 << 30)
    return F.when(path == root, F.lit("")).when(path.startswith(root + "/"), rest)


def file_place(uri: Column) -> Column:
    """Where a file stands among its partition's files, whatever their number: 0 to LAST_PLACE."""
    return F.shiftrightunsigned(F.xxhash64(uri), 64 - PLACE_BITS)
