"""How many files each partition gets, and which shuffle task writes each of them.

All of it is computed by Spark from the inventory: no group is larger than the partitions of one job,
and no partition, however large, is planned in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from packwright.functions.columns import LAST_PLACE, PLACE_BITS, file_place
from packwright.sources.files import partition_size

# Fixed value: the size a compacted file aims at, 128 MiB.
TARGET_BYTES = 134217728

# Output files of one write job (128 MiB each: 1 TiB). A shuffle has readers x writers blocks, so it is
# the number of jobs that grows with the data, not the width of a shuffle.
JOB_FILES = 8192

# A partition with more output files than this is cut by file into slices that are planned alone.
SLICE_FILES = 2048

# The files of one partition are summed up and ordered in 2 ** 12 parts by place, so never in one task. This
# spreads the work; it does not bound the number of slices.
PART_BITS = 12

# Rows move in runs: so many runs of neighbouring rows make one output file. Blocks of a shuffle are then
# 1/64 of a file (2 MiB) at any scale, and neighbours stay together, which keeps files small on disk.
RUNS_PER_FILE = 64

# Partitions that need one file only share a shuffle task, up to this many.
SHARED_TASK_PARTITIONS = 32


def output_files(size: Column, target_bytes: int = TARGET_BYTES) -> Column:
    """Files for so many bytes: the quotient rounded up, at least one."""
    return F.greatest(F.lit(1), F.ceil(size / F.lit(target_bytes))).cast("int")


def compaction_plan(
    files: DataFrame,
    target_bytes: int = TARGET_BYTES,
    by: Iterable[str] = ("table_name", "partition"),
) -> DataFrame:
    """Size of every partition (or table) and the number `n` of files it should have."""
    return partition_size(files, by).withColumn("n", output_files(F.col("bytes"), target_bytes))


def slice_plan(files: DataFrame, target_bytes: int, slice_files: int = SLICE_FILES) -> DataFrame:
    """The plan by slice: a whole partition, or a range of file places of a very large one.

    A partition with more than `slice_files` output files is cut where the running sum of its files' bytes,
    by place, passes each equal share: bytes are summed per part of the places, the parts are added up, and
    the files are ordered within their part. However large the partition, no slice has more than
    `slice_files` output files, but where one file alone has as many or only one or two are allowed. A slice
    gets one of the partition's files, and of the spare ones its share by bytes, so that they add up.
    """
    leaf = ["partition", "leaf_uri"]
    whole = Window.partitionBy(*leaf)
    placed = files.select(*leaf, "bytes", file_place(F.col("uri")).alias("place")).withColumn(
        "part", F.shiftright("place", PLACE_BITS - PART_BITS)
    )
    # A share leaves room for the file that crosses its end, and for the one output file each slice gets.
    share = F.greatest(F.lit(1), F.lit(slice_files - 1) - F.ceil(F.col("largest") / F.lit(target_bytes)))
    parts = (
        placed.groupBy(*leaf, "part")
        .agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest"))
        .withColumn("largest", F.max("largest").over(whole))
        .withColumn("leaf_bytes", F.sum("bytes").over(whole))
        .withColumn("leaf_files", output_files(F.col("leaf_bytes"), target_bytes))
        .withColumn(
            "slices", F.when(F.col("leaf_files") <= slice_files, 1).otherwise(F.ceil(F.col("leaf_files") / share))
        )
        .withColumn("part_before", F.sum("bytes").over(_upto(whole, "part")) - F.col("bytes"))
    )
    uncut = (
        parts.where("slices = 1")
        .groupBy(*leaf, "leaf_bytes", "leaf_files")
        .agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        .select(
            *leaf,
            F.lit(0).cast("bigint").alias("first_place"),
            F.lit(LAST_PLACE).alias("last_place"),
            "files",
            "bytes",
            "leaf_bytes",
            F.col("leaf_files").alias("n"),
        )
    )
    before = F.col("part_before") + F.sum("bytes").over(_upto(Window.partitionBy(*leaf, "part"), "place")) - F.col("bytes")
    cut = (
        placed.groupBy(*leaf, "part", "place")
        .agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
        .join(parts.where("slices > 1").drop("files", "bytes", "largest"), [*leaf, "part"])
        .withColumn("before", before)
        .withColumn(
            "slice",
            F.expr("least(cast(before as decimal(20,0)) * slices div greatest(leaf_bytes, 1), slices - 1)"),
        )
        .groupBy(*leaf, "slice", "leaf_bytes", "leaf_files")
        .agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.min("place").alias("first"))
    )
    spare = "cast(({bytes}) as decimal(20,0)) * (leaf_files - parts) div greatest(leaf_bytes, 1)"
    upto, so_far = spare.format(bytes="bytes_so_far"), spare.format(bytes="bytes_so_far - bytes")
    in_order = whole.orderBy("slice")
    cut = (
        cut.withColumn("bytes_so_far", F.sum("bytes").over(_upto(whole, "slice")))
        .withColumn("parts", F.count("*").over(whole))
        .select(
            *leaf,
            F.when(F.row_number().over(in_order) == 1, 0).otherwise(F.col("first")).alias("first_place"),
            F.coalesce(F.lead("first").over(in_order) - 1, F.lit(LAST_PLACE)).alias("last_place"),
            "files",
            "bytes",
            "leaf_bytes",
            F.expr(f"cast(1 + ({upto}) - ({so_far}) as int)").alias("n"),
        )
    )
    return uncut.union(cut)


def is_cut(first: Column, last: Column) -> Column:
    """Whether a slice is only a part of its partition."""
    return (first > 0) | (last < F.lit(LAST_PLACE))


def _upto(group: WindowSpec, order: str) -> WindowSpec:
    """The rows of a group up to this one."""
    return group.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def job_plan(
    slices: DataFrame, digest: DataFrame, groups: int, job_files: int, target_bytes: int
) -> DataFrame:
    """Give every slice a write job and its place among that job's shuffle tasks.

    `digest` has the rows and the fingerprint of each directory, which every slice of it gets.

    Slices are dealt to `groups` by hash and cut within a group by running sum, so a job never holds more
    than `job_files` files and one slice. Inside a job, a slice of n > 1 files owns tasks
    `first_task .. first_task + n - 1`, and so does a slice of a cut partition: two slices of one directory
    never meet in a task. Whole partitions of one file share the tasks after those.
    """
    group = F.pmod(F.xxhash64("leaf_uri", "first_place"), F.lit(groups))
    dealt = slices.join(digest, "leaf_uri", "left").withColumn("job_group", group)
    in_group = (
        Window.partitionBy("job_group")
        .orderBy("leaf_uri", "first_place")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = F.sum("n").over(in_group) - F.col("n")
    job = F.concat_ws("-", "job_group", F.floor(before / F.lit(job_files)))
    in_job = Window.partitionBy("job")
    running = in_job.orderBy("leaf_uri", "first_place").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    cut = is_cut(F.col("first_place"), F.col("last_place"))
    alone = cut | (F.col("n") > 1)
    own = F.when(alone, F.col("n")).otherwise(0)
    floor_bytes = F.lit(max(1, target_bytes // SHARED_TASK_PARTITIONS))
    shared = F.when(alone, 0).otherwise(F.greatest(F.col("bytes"), floor_bytes))
    shared_before = F.sum(shared).over(running) - shared
    first_task = F.when(alone, F.sum(own).over(running) - own).otherwise(
        F.sum(own).over(in_job) + F.floor(shared_before / F.lit(target_bytes))
    )
    run_rows = F.greatest(
        F.lit(1),
        F.floor(
            F.col("rows") * (F.col("bytes") / F.greatest(F.col("leaf_bytes"), F.lit(1)))
            / (F.col("n") * F.lit(RUNS_PER_FILE))
        ),
    )
    return (
        dealt.withColumn("job", job)
        .withColumn("first_task", first_task.cast("int"))
        .withColumn("tasks", F.max(F.col("first_task") + F.col("n")).over(in_job).cast("int"))
        .withColumn("run_rows", F.coalesce(run_rows, F.lit(1)).cast("bigint"))
        .withColumn("slice_id", F.row_number().over(in_job.orderBy("leaf_uri", "first_place")))
        .drop("job_group", "leaf_bytes")
    )


def task_of_row(uri: Column, row_index: Column) -> Column:
    """The shuffle task of a row, from its slice's plan columns and its place in its file.

    File and row index do not change when a task is run again, so neither does the answer.
    """
    n, first = F.col("__pw_n"), F.col("__pw_first_task")
    run = F.floor(row_index / F.col("__pw_run_rows"))
    offset = F.pmod(F.pmod(F.xxhash64(uri), n) + run, n)
    return F.when(n == 1, first).otherwise(first + offset).cast("int")
