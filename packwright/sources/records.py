"""Records of delimited text files: cut at the right line breaks, while large files stay split.

A line break inside quotes belongs to a value. Whether a split starts inside quotes follows from the quotes of all
splits before it in its file: they are counted per split, added up along the file, and every split then knows where
its first record begins. Records that reach over the end of a split are put together from their parts; nothing else
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packwright.errors import MaintenanceError

# Splits that start inside quotes are named to the tasks: at most so many, some 200 bytes each. A split has
# `spark.sql.files.maxPartitionBytes` (128 MiB), so this is reached beyond 25 TB only.
NAMED_SPLITS = 200_000

_WHOLE, _HEAD, _TAIL = 0, 1, 2


def text_lines(spark: SparkSession, pattern: str, options: dict[str, str]) -> DataFrame:
    """value, file, block: every line, with its file and the place where its split begins."""
    reader = spark.read.options(**options).option("lineSep", "\n").option("recursiveFileLookup", "true")
    scan = reader.option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false").text(pattern)
    metadata = scan.metadataColumn("_metadata")
    return scan.select(
        "value", metadata.getField("file_path").alias("file"), metadata.getField("file_block_start").alias("block")
    )


def quotes(value: Column, quote: str, escape: str) -> Column:
    """How many quotes of a text open or close a value: escaped ones do neither, doubled ones do both."""
    if not quote:
        return F.lit(0)
    if escape and escape != quote:
        value = F.replace(F.replace(value, F.lit(escape + escape), F.lit("")), F.lit(escape + quote), F.lit(""))
    return F.length(value) - F.length(F.replace(value, F.lit(quote), F.lit("")))


def closed(value: Column, quote: str, escape: str) -> Column:
    """The record, if all its quotes are closed; else the job stops."""
    message = F.concat(F.lit("a quote is not closed before the end of the record (multi_line?): "), F.substring(value, 1, 80))
    return F.when(quotes(value, quote, escape) % 2 == 0, value).otherwise(F.raise_error(message))


def single_lines(lines: DataFrame, quote: str, escape: str) -> DataFrame:
    """A record per line, in one column `value`. A quote that stays open stops the job."""
    return lines.select(closed(_without_return(F.col("value")), quote, escape).alias("value"))


def joined_lines(lines: DataFrame, quote: str, escape: str, multi_line: bool, header: bool) -> DataFrame:
    """Records that may hold line breaks inside quotes, and without the first record of each file if it is a
    header, in one column `value`."""
    inside = _splits_inside(lines, quote, escape) if multi_line and quote else set()
    cut = lines.mapInArrow(
        _cutter(inside, quote if multi_line else "", escape, header), "value string, file string, block long, kind int"
    )
    along = Window.partitionBy("file").orderBy("block", "kind").rowsBetween(Window.unboundedPreceding, 0)
    parts = cut.where(F.col("kind") != _WHOLE).withColumn("record", F.sum((F.col("kind") == _TAIL).cast("int")).over(along))
    in_order = F.array_sort(F.collect_list(F.struct("block", "kind", "value")))
    across = parts.groupBy("file", "record").agg(
        F.array_join(F.transform(in_order, lambda p: p["value"]), "\n").alias("value")
    )
    whole = cut.where(F.col("kind") == _WHOLE).select("value")
    records = whole.union(across.select("value")) if multi_line else whole
    return records.select(closed(_without_return(F.col("value")), quote, escape).alias("value"))


def _without_return(value: Column) -> Column:
    """A line break may be \\r\\n."""
    return F.when(value.endswith("\r"), F.left(value, F.length(value) - 1)).otherwise(value)


def _splits_inside(lines: DataFrame, quote: str, escape: str) -> set[tuple[str, int]]:
    """The splits whose first line begins inside quotes."""
    counted = lines.groupBy("file", "block").agg(F.sum(quotes(F.col("value"), quote, escape)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = counted.withColumn("before", F.sum("n").over(before)).where("before % 2 = 1").select("file", "block")
    found = odd.limit(NAMED_SPLITS + 1).collect()
    if len(found) > NAMED_SPLITS:
        raise MaintenanceError(f"more than {NAMED_SPLITS} splits start inside quotes: load in parts, or in larger splits")
    return {(r.file, r.block) for r in found}


def _cutter(inside: set[tuple[str, int]], quote: str, escape: str, header: bool):
    """Cut the lines of each split, which come in order, into records and what reaches over its ends."""

    def count(values: pa.Array) -> np.ndarray:
        if not quote:
            return np.zeros(len(values), np.int64)
        if escape and escape != quote:
            values = pc.replace_substring(pc.replace_substring(values, escape + escape, ""), escape + quote, "")
        return pc.count_substring(values, quote).to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, held, kind, skip = None, [], _WHOLE, False
        out: list[tuple[str, str, int, int]] = []

        def done(record: str, kind: int) -> None:
            nonlocal skip
            if skip and kind == _WHOLE:
                skip = False
            else:
                out.append((record, *split, kind))

        for batch in batches:
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_numpy()
            new = [0, *[i for i in range(1, len(files)) if blocks[i] != blocks[i - 1] or files[i] != files[i - 1]], len(files)]
            for first, last in zip(new, new[1:], strict=False):
                values = batch.column("value").slice(first, last - first)
                if (here := (files[first], int(blocks[first]))) != split:
                    if held:
                        done("\n".join(held), _TAIL if kind == _WHOLE else _HEAD)
                    split, held, skip = here, [], header and here[1] == 0
                    kind = _HEAD if here in inside else _WHOLE
                    open_ = here in inside
                n = count(values)
                after = (open_ + np.cumsum(n)) % 2 == 1
                texts = values.to_pylist()
                at = 0
                for end in np.flatnonzero(~after).tolist():
                    if held or kind == _HEAD or end > at:
                        done("\n".join([*held, *texts[at : end + 1]]), kind)
                        held, kind = [], _WHOLE
                    else:
                        done(texts[end], _WHOLE)
                    at = end + 1
                held += texts[at:]
                open_ = bool(after[-1])
            if len(out) >= 10_000:
                yield _rows(out)
                out = []
        if held:
            done("\n".join(held), _TAIL if kind == _WHOLE else _HEAD)
        if out:
            yield _rows(out)

    return run


def _rows(out: list[tuple[str, str, int, int]]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["value", "file", "block", "kind"]
    )
