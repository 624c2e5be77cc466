"""Rewrite tables into right-sized Parquet files, check every row, then swap.

One table is one scan, one plan and as few write jobs as its size allows (one job per TiB). A job is one
shuffle: rows go in runs of neighbours to the task that writes their file, by file and row index, so a
task that is run again after a lost executor sends the same rows to the same place.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from packwright.errors import (
    BrokenSwapError,
    InventoryError,
    LateFileError,
    MaintenanceError,
    PromotionError,
    VerificationError,
)
from packwright.functions.columns import LAST_PLACE, below, file_place, file_uri, named, parent
from packwright.operators.promote import (
    RETIRED_SUFFIX,
    finish_swap,
    journal_path,
    keep_sources,
    map_path,
    promote_table,
    refresh_readers,
    staging_path,
    swap,
    table_location,
    undo_swap,
)
from packwright.operators.verify import compare_leaves, leaf_digest, tagged, tree_facts
from packwright.plans.compaction import (
    JOB_FILES,
    SLICE_FILES,
    TARGET_BYTES,
    compaction_plan,
    is_cut,
    job_plan,
    slice_plan,
    task_of_row,
)
from packwright.session import JOB_SETTINGS, LISTING_SETTINGS, freeze, scratch_dir, settings
from packwright.sources.files import list_files
from packwright.sources.parquet import read_files
from packwright.storage import Storage, in_threads, normalise

# Directory names a transaction log goes by: such a table must be compacted by its own format's means.
TRANSACTION_LOGS = ("_delta_log", ".hoodie", "_spark_metadata", "metadata/version-hint.text")

# Hidden directories that writers leave behind; any other one inside a table stops the job.
LEFTOVERS = ("_temporary", ".spark-staging", ".hive-staging", ".packwright-")

# The plan of a job is broadcast: at most so many slices of some 300 bytes, since `job_files` may not be more.
BROADCAST_SLICES = 65536

# A job names at most so many files and directories to the reader.
NAMED_FILES = 200_000

# `key=value` directories whose text Spark writes back unchanged; all others are written by number and
# renamed.
_PLAIN_KEYS = re.compile(r"[A-Za-z0-9_]+(/[A-Za-z0-9_]+)*")
_PLAIN_PARTITION = r"^[A-Za-z0-9_]+=[A-Za-z0-9_.+ -]+(/[A-Za-z0-9_]+=[A-Za-z0-9_.+ -]+)*$"


@dataclass(frozen=True)
class Options:
    """How to rewrite. `job_files` and `slice_files` bound one write job and one part of a partition."""

    target_bytes: int = TARGET_BYTES
    verify: str = "full"
    only_if_files_exceed_plan: bool = False
    codec: str | None = None
    job_files: int = JOB_FILES
    slice_files: int = SLICE_FILES

    def __post_init__(self):
        if min(self.target_bytes, self.job_files, self.slice_files) < 1:
            raise MaintenanceError("target_bytes, job_files and slice_files must be positive")
        if self.job_files > BROADCAST_SLICES:
            raise MaintenanceError(f"job_files must be at most {BROADCAST_SLICES}")


def compact_database(
    spark: SparkSession,
    base: str,
    *,
    tables: Iterable[str] | None = None,
    swap_in: bool = True,
    concurrency: int = 4,
    refresh: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Compact every table below `base`, verify, and put the result in place. Returns the report.

    The report has a row per partition: table_name, partition, files_before, files_planned, files_after,
    bytes_before, bytes_after, rows_before, rows_after, equal. If any row is not equal, a file came or
    went meanwhile, or a step failed, an error is raised and nothing has changed. With `swap_in=False`
    the copy is left at `<base>_bkup` for `promote`. `concurrency` tables are worked on at a time.
    """
    opts = Options(**options)
    live = normalise(base)
    storage = Storage(spark, live)
    staging = staging_path(live)
    retired = live + RETIRED_SUFFIX
    for path in (staging, retired, journal_path(live)):
        if storage.exists(path):
            raise MaintenanceError(f"{path} is left from an earlier run; see recover(), then remove it")
    scratch = scratch_dir(spark, "compact")
    wanted = None if tables is None else sorted(set(tables))
    files = _inventory(spark, live, wanted, f"{scratch}/files")
    sizes = _checked_tables(storage, live, files, wanted, opts.target_bytes)
    names = list(sizes)

    def work(number: int, name: str) -> list[str]:
        place = f"{scratch}/table={number}"
        return _rewrite_table(
            spark,
            files.where(F.col("table_name") == name),
            sizes[name],
            f"{live}/{name}",
            map_path(f"{live}/{name}", live, staging),
            place,
            opts,
        )

    with settings(spark, JOB_SETTINGS):
        try:
            with ThreadPoolExecutor(max(1, concurrency)) as pool:
                target = inheritable_thread_target(spark)(work)
                parts = list(pool.map(target, range(len(names)), names))
            report = _report(spark, scratch, names, parts)
            _require_equal(report)
            _require_unchanged(spark, live, names, files)
            for name, done in zip(names, parts):
                _copy_rights(storage, f"{live}/{name}", f"{staging}/{name}", done)
            if not swap_in:
                keep_sources(files, live, staging)
            else:
                swapped = _swap_in(storage, live, staging, retired, names, parts)
                _require_no_late_files(spark, storage, live, retired, swapped, files)
                finish_swap(storage, live)
        except (BrokenSwapError, LateFileError):
            raise
        except Exception:
            storage.delete(staging)
            raise
    if swap_in:
        storage.delete(retired)
        storage.delete(staging)
        refresh_readers(spark, live, refresh)
    return report


def compact_table(
    spark: SparkSession, path: str, out: str, **options
) -> DataFrame:
    """Compact one table into a new directory `out`, verify it, and return the report.

    `path` is not touched. `promote(spark, path, out)` puts the copy in place; on object stores leave it
    there and point the catalog table at it.
    """
    opts = Options(**options)
    table, target = normalise(path), normalise(out)
    map_path(table, table, target)
    storage = Storage(spark, table)
    if storage.exists(target):
        raise MaintenanceError(f"{target} exists")
    scratch = scratch_dir(spark, "compact")
    base, name = table.rsplit("/", 1)
    files = _inventory(spark, base, [name], f"{scratch}/files")
    sizes = _checked_tables(storage, base, files, [name], opts.target_bytes)
    with settings(spark, JOB_SETTINGS):
        try:
            parts = _rewrite_table(
                spark, files, sizes[name], table, target, f"{scratch}/table=0", opts
            )
            report = _report(spark, scratch, [name], [parts])
            _require_equal(report)
            _require_unchanged(spark, base, [name], files)
            _copy_rights(storage, table, target, parts)
            keep_sources(files, table, target)
        except Exception:
            storage.delete(target)
            raise
    return report


def compact_catalog_table(spark: SparkSession, table: str, out: str, **options) -> DataFrame:
    """Compact the files of a catalog table into a new directory and point the table at it; returns the report.

    Nothing is renamed, so it serves object stores; the old directory is left for the caller to remove. The copy is
    verified as it is made, and once more by row counts when the table is pointed at it.
    """
    report = compact_table(spark, table_location(spark, table), out, **options)
    promote_table(spark, table, out, verify="rows")
    return report


def compact_partition(spark: SparkSession, path: str, out: str, **options) -> DataFrame:
    """Compact one partition directory into a new directory; its files lie in it directly."""
    return compact_table(spark, path, out, **options)


def _inventory(spark: SparkSession, base: str, tables: list[str] | None, path: str) -> DataFrame:
    with settings(spark, {**JOB_SETTINGS, **LISTING_SETTINGS}):
        return freeze(list_files(spark, base, tables), path)


def _checked_tables(
    storage: Storage,
    base: str,
    files: DataFrame,
    wanted: list[str] | None,
    target_bytes: int,
) -> dict[str, int]:
    """Tables that have files, after every check that needs only the listing.

    The value is about how many files the table will have; the plan has the exact numbers.
    """
    root = storage.qualified(base) + "/"
    loose = F.col("path") == F.concat(F.lit(root), F.col("table_name"))
    outside = ~F.col("path").startswith(root)
    found = (
        files.groupBy("table_name")
        .agg(
            F.max(loose | outside).alias("bad"),
            F.approx_count_distinct("leaf_uri").alias("leaves"),
            F.sum("bytes").alias("bytes"),
        )
        .collect()
    )
    bad = sorted(r.table_name for r in found if r.bad)
    if bad:
        raise InventoryError(f"files that belong to no table below {base}: {bad[:5]}")
    tables = {r.table_name: r.leaves + r.bytes // target_bytes for r in sorted(found)}
    missing = sorted(set(wanted or ()) - set(tables))
    if missing or not tables:
        raise InventoryError(f"no files below {base} for {missing or 'any table'}")
    for name in tables:
        for log in TRANSACTION_LOGS:
            if storage.exists(f"{base}/{name}/{log}"):
                raise MaintenanceError(f"{name} has a transaction log ({log})")
        hidden = storage.directories(f"{base}/{name}")[1]
        lost = [d for d in hidden if not d.rsplit("/", 1)[-1].startswith(LEFTOVERS)]
        if lost:
            raise MaintenanceError(f"{name} has hidden folders that a swap would remove: {lost[:5]}")
    return tables


def _copy_rights(storage: Storage, live: str, copy: str, parts: list[str]) -> None:
    """Give the directories of a copy the access rights of those they stand for."""
    for part in parts:
        old, new = f"{live}/{part}".rstrip("/"), f"{copy}/{part}".rstrip("/")
        there = set(storage.directories(old)[0])
        both = [d for d in storage.directories(new)[0] if d in there]
        in_threads(lambda d, o=old, n=new: storage.copy_rights(f"{o}/{d}".rstrip("/"), f"{n}/{d}".rstrip("/")), both)


def _rewrite_table(
    spark: SparkSession,
    files: DataFrame,
    expected_files: int,
    source: str,
    target: str,
    scratch: str,
    opts: Options,
) -> list[str]:
    """Write the compacted copy and the report of one table, about `expected_files` files in all.

    Returns the partitions to swap, or [""] for the whole table directory.
    """
    storage = Storage(spark, source)
    root = storage.uri(source)
    parts = [""]
    if opts.only_if_files_exceed_plan:
        todo = freeze(_partitions_to_do(files, opts), f"{scratch}/todo")
        parts = [r.partition for r in todo.select("partition").orderBy("partition").collect()]
        if not parts:
            return []
        if _nested(files):
            parts = [""]
        else:
            files = files.join(todo.select("leaf_uri"), "leaf_uri", "left_semi")
    scan = read_files(spark, *[f"{source}/{part}".rstrip("/") for part in parts])
    before = leaf_digest(scan, opts.verify)
    slices = slice_plan(files, opts.target_bytes, opts.slice_files)
    groups = max(1, -(-expected_files // opts.job_files))
    plan = freeze(
        job_plan(slices, before, groups, opts.job_files, opts.target_bytes), f"{scratch}/plan"
    )
    jobs = _jobs(plan)
    sources = _Sources(scan, files, source)
    _write_jobs(sources, plan, jobs, storage, target, opts)
    if any(job.empty for job in jobs):
        _keep_empty(spark, scan, plan, storage, target)

    old = plan.groupBy("leaf_uri").agg(
        F.max("partition").alias("partition"),
        F.sum("n").cast("int").alias("files_planned"),
        F.sum("files").alias("files"),
        F.sum("bytes").alias("bytes"),
        F.max("rows").alias("rows"),
        F.max("fingerprint").alias("fingerprint"),
    )
    report = compare_leaves(
        tagged("before", old, root),
        *tree_facts(spark, "after", target, scan.schema, opts.verify),
    )
    freeze(
        report.select(
            F.lit(source.rsplit("/", 1)[1]).alias("table_name"),
            F.coalesce("partition", "leaf").alias("partition"),
            "files_before",
            "files_planned",
            "files_after",
            "bytes_before",
            "bytes_after",
            "rows_before",
            "rows_after",
            "equal",
        ),
        f"{scratch}/report",
    )
    return parts


def _partitions_to_do(files: DataFrame, opts: Options) -> DataFrame:
    """Directories that have more files than planned: partition, leaf_uri."""
    plan = compaction_plan(files, opts.target_bytes, ["partition", "leaf_uri"])
    return plan.where(F.col("n_files") > F.col("n")).select("partition", "leaf_uri")


def _nested(files: DataFrame) -> bool:
    """Whether a directory with files lies inside another one: then only the whole table can be swapped."""
    leaves = files.select("partition").distinct()
    above = leaves.where("partition <> ''").selectExpr(
        "partition", "explode(sequence(0, size(split(partition, '/')) - 1)) AS levels"
    )
    above = above.selectExpr("substring_index(partition, '/', levels) AS partition")
    return not above.join(leaves, "partition", "left_semi").isEmpty()


def _jobs(plan: DataFrame) -> list[Row]:
    """The write jobs of a table: one row per job, so per TiB of data."""
    signature = F.regexp_replace("partition", "=[^/]*", "")
    return (
        plan.groupBy("job")
        .agg(
            F.max("tasks").alias("tasks"),
            F.count("*").alias("slices"),
            F.max(is_cut(F.col("first_place"), F.col("last_place"))).alias("sliced"),
            F.min(signature).alias("first_signature"),
            F.max(signature).alias("last_signature"),
            F.min(F.col("partition").rlike(_PLAIN_PARTITION)).alias("plain"),
            F.max(F.coalesce("rows", F.lit(0)) == 0).alias("empty"),
        )
        .orderBy("job")
        .collect()
    )


def _write_jobs(
    sources: _Sources,
    plan: DataFrame,
    jobs: list[Row],
    storage: Storage,
    target: str,
    opts: Options,
) -> None:
    """Run the write jobs of one table, one after the other: each is as wide as a cluster can use."""
    keys = _partition_keys(sources.scan, jobs)
    for job in jobs:
        mine = plan.where(F.col("job") == job.job)
        source = sources.scan if len(jobs) == 1 else sources.of_job(mine.collect())
        rows = _placed(source, F.broadcast(mine), job.sliced, keys)
        writer = rows.repartitionById(job.tasks, F.col("__pw_task")).drop("__pw_task").write
        writer = writer.mode("append").option("maxRecordsPerFile", 0)
        if opts.codec:
            writer = writer.option("compression", opts.codec)
        if keys is None:
            numbered = f"{target}/.by_number-{uuid.uuid4().hex}"
            writer.partitionBy("__pw_slice").parquet(numbered)
            written = set(storage.child_dirs(numbered))
            names = mine.select("slice_id", "partition", "first_place", "last_place").collect()
            storage.move_into(
                (
                    f"{numbered}/__pw_slice={r.slice_id}",
                    f"{target}/{r.partition}".rstrip("/"),
                    "" if _whole(r) else f"slice-{r.slice_id}-",
                )
                for r in names
                if f"__pw_slice={r.slice_id}" in written
            )
            storage.delete(numbered)
        elif keys:
            writer.partitionBy(*keys).parquet(target)
        else:
            writer.parquet(target)


def _partition_keys(scan: DataFrame, jobs: list[Row]) -> list[str] | None:
    """The partition columns if every directory is `key=value` text that Spark writes back the same.

    [] for a table whose files lie in its own directory; None for opaque, mixed or odd names.
    """
    signatures = {s for job in jobs for s in (job.first_signature, job.last_signature)}
    if signatures == {""}:
        return []
    signature = signatures.pop()
    if signatures or not all(j.plain for j in jobs) or not _PLAIN_KEYS.fullmatch(signature):
        return None
    keys = signature.split("/")
    lowered = {k.lower() for k in keys}
    clash = lowered & {c.lower() for c in scan.columns}
    return keys if len(lowered) == len(keys) and not clash else None


class _Sources:
    """What the write jobs of a table read: all of it, or the files of one job."""

    def __init__(self, scan: DataFrame, files: DataFrame, path: str):
        self.scan = scan
        self._files = files
        self._path = path
        self._inside: bool | None = None

    def of_job(self, slices: list[Row]) -> DataFrame:
        """The rows of a job's slices; no other file is opened.

        Read by path where a directory holds nothing but its own partition and the files of cut
        partitions are not too many to name. Otherwise by a predicate on file names, which Spark applies
        to its listing but also, at some cost, to every row.
        """
        if self._inside is None:
            self._inside = _nested(self._files)
        if not self._inside:
            whole = [f"{self._path}/{r.partition}".rstrip("/") for r in slices if _whole(r)]
            cut = [r for r in slices if not _whole(r)]
            if cut:
                mine = self._files.where(_in_slices(cut, F.col("leaf_uri"), F.col("uri")))
                whole += [r.path for r in mine.select("path").limit(NAMED_FILES + 1).collect()]
            if len(whole) <= NAMED_FILES:
                return read_files(self.scan.sparkSession, *whole, schema=self.scan.schema)
        uri = file_uri(self.scan)
        return self.scan.where(_in_slices(slices, parent(uri), uri))


def _whole(piece: Row) -> bool:
    return piece.first_place == 0 and piece.last_place == LAST_PLACE


def _in_slices(slices: list[Row], leaf: Column, uri: Column) -> Column:
    """Whether a file, by its directory and name, belongs to one of some slices."""
    whole = [r.leaf_uri for r in slices if _whole(r)]
    terms = [leaf.isin(whole)] if whole else []
    for r in slices:
        if not _whole(r):
            in_slice = file_place(uri).between(r.first_place, r.last_place)
            terms.append((leaf == r.leaf_uri) & in_slice)
    return reduce(or_, terms)


def _placed(scan: DataFrame, plan: DataFrame, sliced: bool, keys: list[str] | None) -> DataFrame:
    """The rows of one job with the shuffle task, and the partition, of each."""
    metadata = scan.metadataColumn("_metadata")
    uri = metadata.getField("file_path")
    rows = scan.select(
        *[named(c) for c in scan.columns],
        uri.alias("__pw_uri"),
        parent(uri).alias("__pw_leaf"),
        metadata.getField("row_index").alias("__pw_row"),
    )
    values = F.split("partition", "/")
    places = plan.select(
        F.col("leaf_uri").alias("__pw_plan_leaf"),
        F.col("first_place").alias("__pw_first_place"),
        F.col("last_place").alias("__pw_last_place"),
        F.col("n").alias("__pw_n"),
        F.col("first_task").alias("__pw_first_task"),
        F.col("run_rows").alias("__pw_run_rows"),
        F.col("slice_id").alias("__pw_slice"),
        *[
            F.regexp_replace(values[i], "^[^=]*=", "").alias(f"__pw_key{i}")
            for i in range(len(keys or ()))
        ],
    )
    here = F.col("__pw_leaf") == F.col("__pw_plan_leaf")
    if sliced:
        here = here & file_place(F.col("__pw_uri")).between(
            F.col("__pw_first_place"), F.col("__pw_last_place")
        )
    task = task_of_row(F.col("__pw_uri"), F.col("__pw_row"))
    if keys is None:
        where = [F.col("__pw_slice")]
    else:
        where = [F.col(f"__pw_key{i}").alias(key) for i, key in enumerate(keys)]
    return rows.join(places, here).select(
        *[named(c) for c in scan.columns], *where, task.alias("__pw_task")
    )


def _keep_empty(
    spark: SparkSession,
    scan: DataFrame,
    plan: DataFrame,
    storage: Storage,
    target: str,
) -> None:
    """Give a partition whose files hold no row one file with the schema, as it had."""
    rows = plan.groupBy("partition").agg(F.max(F.coalesce("rows", F.lit(0))).alias("rows"))
    empty = [r.partition for r in rows.where("rows = 0").select("partition").collect()]
    if not empty:
        return
    blank = f"{target}/.blank-{uuid.uuid4().hex}"
    spark.createDataFrame([], scan.schema).repartition(1).write.mode("append").parquet(blank)
    name = next(n for n in storage.child_files(blank) if not n.startswith(("_", ".")))
    for partition in empty:
        place = f"{target}/{partition}".rstrip("/")
        storage.mkdirs(place)
        if all(n.startswith(("_", ".")) for n in storage.child_files(place)):
            storage.copy_file(f"{blank}/{name}", f"{place}/{name}")
    storage.delete(blank)


def _report(
    spark: SparkSession, scratch: str, names: list[str], parts: list[list[str]]
) -> DataFrame:
    """The report of all tables, from the files each table's work has written."""
    paths = [f"{scratch}/table={i}/report" for i in range(len(names)) if parts[i]]
    schema = (
        "table_name string, partition string, files_before bigint, files_planned int, "
        "files_after bigint, bytes_before bigint, bytes_after bigint, rows_before bigint, "
        "rows_after bigint, equal boolean"
    )
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def _require_equal(report: DataFrame) -> None:
    wrong = report.where(~F.coalesce("equal", F.lit(False))).limit(5).collect()
    if wrong:
        raise VerificationError(f"partitions differ from their originals, for instance {wrong}")


def _require_unchanged(
    spark: SparkSession, base: str, tables: list[str], files: DataFrame
) -> None:
    """List again: a file that came, went or changed while the copy was made stops the swap."""
    columns = ["path", "bytes", "modified"]
    with settings(spark, LISTING_SETTINGS):
        then = files.select(*columns, F.lit(1).alias("side"))
        now = list_files(spark, base, tables).select(*columns, F.lit(-1).alias("side"))
        both = then.unionAll(now).groupBy(*columns).agg(F.sum("side").alias("side"))
        seen = [r.path for r in both.where("side <> 0").limit(5).collect()]
    if seen:
        raise InventoryError(f"files changed while the copy was made: {seen}")


def _swap_in(
    storage: Storage,
    live: str,
    staging: str,
    retired: str,
    names: list[str],
    parts: list[list[str]],
) -> list[tuple[str, str, str]]:
    """Swap table by table (or partition by partition), all or none; returns what was swapped."""
    triples = []
    for name, partitions in zip(names, parts):
        for partition in partitions:
            below_base = f"{name}/{partition}".rstrip("/")
            old = f"{retired}/{below_base}"
            storage.mkdirs(old.rsplit("/", 1)[0])
            triples.append((f"{live}/{below_base}", f"{staging}/{below_base}", old))
    try:
        swap(storage, live, triples)
    except PromotionError:  # undone: only the empty directories made above are left
        storage.delete(retired)
        raise
    return triples


def _require_no_late_files(
    spark: SparkSession,
    storage: Storage,
    live: str,
    retired: str,
    swapped: list[tuple[str, str, str]],
    files: DataFrame,
) -> None:
    """List what was swapped out: a file that came or changed after the last listing undoes the swap.

    The copy then stays at `<base>_bkup`, since files may have come into it while it was live.
    """
    if not swapped:
        return
    root, old = storage.qualified(live), storage.qualified(retired)
    moved = F.concat(F.lit(root), F.substring(F.col("path"), len(old) + 1, 1 << 20)).alias("path")
    with settings(spark, LISTING_SETTINGS):
        now = list_files(spark, retired, storage.child_dirs(retired)).select(moved, "bytes", "modified")
        late = now.join(files.select("path", "bytes", "modified"), ["path", "bytes", "modified"], "left_anti")
        seen = [r.path for r in late.limit(5).collect()]
    if not seen:
        return
    undo_swap(storage, live, swapped)
    storage.delete(retired)
    raise LateFileError(f"files came during the swap, which was undone: {seen}")
