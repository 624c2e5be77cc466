from __future__ import annotations

import os
from collections import Counter

from pyspark.sql import functions as F


def visible_files(path):
    """Relative path -> size of every visible file below a directory."""
    found = {}
    for folder, inner, names in os.walk(path):
        inner[:] = [d for d in inner if not d.startswith((".", "_"))]
        for name in names:
            if not name.startswith(("_", ".")):
                full = os.path.join(folder, name)
                found[os.path.relpath(full, path)] = os.path.getsize(full)
    return found


def leaf_dirs(path):
    return {os.path.dirname(f) for f in visible_files(path)}


def files_in(path, partition=""):
    return [f for f in visible_files(path) if os.path.dirname(f) == partition]


def rows_by_file(spark, path):
    """Multiset of (directory, row as JSON) from a read of every file by itself."""
    counted = Counter()
    folders = {}
    for name in visible_files(path):
        folders.setdefault(os.path.dirname(name), []).append(os.path.join(path, name))
    for folder, names in folders.items():
        df = spark.read.option("mergeSchema", "true").parquet(*["file:" + _uri(n) for n in names])
        df = df.select([f"`{c}`" for c in sorted(df.columns)])
        text = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("j"))
        counted.update((folder, r.j) for r in text.collect())
    return counted


def _uri(path):
    return "".join("\\" + c if c in "{}[]*?" else c for c in path)


def write_rows(spark, rows, path, files=4):
    rows.repartition(files).write.mode("append").parquet(path)


def snapshot(path):
    return {f: (s, os.path.getmtime(os.path.join(path, f))) for f, s in visible_files(path).items()}
