from __future__ import annotations

import os
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from helpers import visible_files, write_rows
from pyspark.sql import functions as F

import packwright as pw
from packwright.errors import MaintenanceError, PromotionError
from packwright.functions.columns import LAST_PLACE
from packwright.plans.compaction import SHARED_TASK_PARTITIONS, job_plan, slice_plan
from packwright.session import settings
from packwright.sources.parquet import read_files
from packwright.storage import Storage, literal, normalise

ODD = ["mm=01", "k=a b%3Ac", "k=x+y%25z", "20240101", "k=__HIVE_DEFAULT_PARTITION__", "ä/b=1"]


def test_names_and_sizes_are_those_of_the_file_system(spark, place):
    base = f"{place}/db"
    for name in ODD:
        write_rows(spark, spark.range(3), f"{base}/odd/{name}", 2)
    write_rows(spark, spark.range(3), f"{base}/flat", 2)
    os.makedirs(f"{base}/odd/empty")
    files = pw.list_files(spark, base + "/")
    got = {os.path.relpath(r.path.removeprefix("file:"), base): r.bytes for r in files.collect()}
    assert got == visible_files(base)
    assert {r.table_name for r in pw.list_tables(files).collect()} == {"odd", "flat"}
    parts = {(r.table_name, r.partition) for r in pw.list_partitions(files).collect()}
    assert parts == {("odd", name) for name in ODD} | {("flat", "")}
    sizes = {(r.table_name, r.partition): r.bytes for r in pw.partition_size(files).collect()}
    assert sum(sizes.values()) == sum(visible_files(base).values())


def test_listing_opens_no_file(spark, place, capsys):
    write_rows(spark, spark.range(3), f"{place}/db/t", 1)
    pw.list_files(spark, f"{place}/db").explain("formatted")
    schema = [x for x in capsys.readouterr().out.splitlines() if x.startswith("ReadSchema")]
    assert schema == ["ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>"]


def test_one_partition_has_its_own_columns_only(spark, place):
    spark.range(6).withColumn("k", F.lit("01")).write.partitionBy("k").parquet(f"{place}/t")
    assert pw.read_partition(spark, f"{place}/t/k=01").columns == ["id"]
    got = {(r.id, r.partition) for r in pw.read_table(spark, f"{place}/t").collect()}
    assert got == {(i, "k=01") for i in range(6)}


@pytest.mark.parametrize(
    ("size", "files"),
    [(0, 1), (1, 1), (134217727, 1), (134217728, 1), (134217729, 2), (10 * 134217728, 10), (1 << 50, 1 << 23)],
)
def test_number_of_files(spark, size, files):
    got = spark.sql(f"SELECT {size}L AS bytes").select(pw.output_files(F.col("bytes")).alias("n"))
    assert got.first().n == files
    assert got.schema["n"].dataType.simpleString() == "int"


def test_the_number_of_listing_tasks_does_not_follow_the_bytes(spark, place):
    write_rows(spark, spark.range(100_000), f"{place}/db/t", 64)
    tasks = set()
    for most in ("1k", "128m", "1g"):
        with settings(spark, {"spark.sql.files.maxPartitionBytes": most, "spark.sql.files.openCostInBytes": "1k"}):
            tasks.add(pw.list_files(spark, f"{place}/db").rdd.getNumPartitions())
    assert tasks == {spark.sparkContext.defaultParallelism}


def _listing(spark, sizes):
    """An inventory of made-up files: (partition, bytes) each."""
    rows = [(p, f"file:/x/{p}", f"file:/x/{p}/f{i}.parquet", b) for i, (p, b) in enumerate(sizes)]
    return spark.createDataFrame(rows, "partition string, leaf_uri string, uri string, bytes bigint")


def _planned(spark, sizes, target, slice_files, job_files, groups):
    listing = _listing(spark, sizes)
    digest = listing.groupBy("leaf_uri").agg(F.sum("bytes").alias("rows"), F.lit("").alias("fingerprint"))
    return job_plan(slice_plan(listing, target, slice_files), digest, groups, job_files, target).collect()


def test_a_large_partition_is_cut_and_all_files_have_one_place(spark):
    sizes = [("hot", 100)] * 600 + [(f"p{i}", 7) for i in range(40)]
    plan = _planned(spark, sizes, target=100, slice_files=64, job_files=128, groups=5)
    hot = sorted((r for r in plan if r.partition == "hot"), key=lambda r: r.first_place)
    assert len(hot) == 10
    assert hot[0].first_place == 0 and hot[-1].last_place == LAST_PLACE
    assert all(a.last_place + 1 == b.first_place for a, b in zip(hot, hot[1:]))
    assert sum(r.n for r in hot) == 600 and sum(r.files for r in hot) == 600
    others = [r for r in plan if r.partition != "hot"]
    assert len(others) == 40 and all(r.n == 1 for r in others)


@pytest.mark.parametrize("sizes", [[1] * 30 + [5000], [5000] + [1] * 30, [37] * 100, [0, 0, 901]])
def test_files_of_a_cut_partition_add_up(spark, sizes):
    listing = _listing(spark, [("p", size) for size in sizes])
    plan = slice_plan(listing, 100, 3).collect()
    assert sum(r.n for r in plan) == -(-sum(sizes) // 100)
    assert min(r.n for r in plan) >= 1 and sum(r.files for r in plan) == len(sizes)


@pytest.mark.parametrize("count, size, slice_files", [(30000, 1 << 40, 2048), (30000, 1 << 30, 2048), (4000, 1 << 27, 3), (5000, 1 << 20, 8)])
def test_no_slice_has_more_files_than_allowed_at_any_size(spark, count, size, slice_files):
    """Invented sizes up to 30 PiB in one partition; more slices than any fixed number of buckets."""
    at = F.concat(F.lit("file:/x/p/f"), F.col("id"))
    listing = spark.range(count).select(
        F.lit("p").alias("partition"), F.lit("file:/x/p").alias("leaf_uri"), at.alias("uri"),
        (F.lit(size) + F.col("id") % 7).alias("bytes"),
    )
    target = 1 << 27 if size >= 1 << 27 else 1 << 20
    plan = slice_plan(listing, target, slice_files).orderBy("first_place").collect()
    total = count * size + sum(i % 7 for i in range(count))
    allowed = max(slice_files, 2 + -(-(size + 7) // target))
    assert sum(r.n for r in plan) == -(-total // target) and sum(r.files for r in plan) == count
    assert 1 <= min(r.n for r in plan) and max(r.n for r in plan) <= allowed
    assert plan[0].first_place == 0 and plan[-1].last_place == LAST_PLACE
    assert all(a.last_place + 1 == b.first_place for a, b in zip(plan, plan[1:]))
    assert len(plan) > 1024 or slice_files > 3


def test_jobs_are_bounded_and_tasks_do_not_overlap(spark):
    sizes = [("hot", 100)] * 600 + [(f"p{i}", 1 + i % 300) for i in range(200)]
    plan = _planned(spark, sizes, target=100, slice_files=64, job_files=128, groups=6)
    for job in {r.job for r in plan}:
        mine = [r for r in plan if r.job == job]
        assert sum(r.n for r in mine) <= 128 + max(r.n for r in mine)
        owned = [t for r in mine if r.n > 1 for t in range(r.first_task, r.first_task + r.n)]
        assert len(owned) == len(set(owned))
        shared = {r.first_task for r in mine if r.n == 1}
        assert not shared & set(owned)
        for task in shared:
            together = [r for r in mine if r.n == 1 and r.first_task == task]
            assert len(together) <= SHARED_TASK_PARTITIONS + 1
            assert sum(r.bytes for r in together) <= 200
        assert {r.tasks for r in mine} == {1 + max(owned + list(shared))}
        assert len({r.slice_id for r in mine}) == len(mine)


@pytest.mark.parametrize("slice_files", [1, 2])
def test_slices_of_one_directory_never_share_a_task(spark, slice_files):
    """200 directories of randomly named files, cut as in a table of mixed names, in several jobs."""
    rng = random.Random(slice_files)
    names = [(f"p{i}", f"file:/x/p{i}/part-{rng.random()}.parquet", rng.randint(900, 6000)) for i in range(200) for _ in range(5)]
    rows = [(p, f"file:/x/{p}", uri, size) for p, uri, size in names]
    listing = spark.createDataFrame(rows, "partition string, leaf_uri string, uri string, bytes bigint")
    digest = listing.groupBy("leaf_uri").agg(F.sum("bytes").alias("rows"), F.lit("").alias("fingerprint"))
    plan = job_plan(slice_plan(listing, 4096, slice_files), digest, 4, 300, 4096).collect()
    assert len(plan) > 250 and len({r.job for r in plan}) >= 4
    places = [(r.job, r.leaf_uri, t) for r in plan for t in range(r.first_task, r.first_task + r.n)]
    assert len(places) == len(set(places))
    assert len({(r.job, r.slice_id) for r in plan}) == len(plan)


def test_one_of_two_renames_onto_a_name_fails(spark, place):
    storage = Storage(spark, place)
    for turn in range(60):
        for side in "ab":
            with open(f"{place}/{side}{turn}", "w") as f:
                f.write(side)

        def move(side, turn=turn):
            try:
                storage.rename(f"{place}/{side}{turn}", f"{place}/to{turn}")
            except PromotionError:
                return 0
            return 1

        with ThreadPoolExecutor(2) as pool:
            assert sum(pool.map(move, "ab")) == 1
        left = [s for s in "ab" if os.path.exists(f"{place}/{s}{turn}")]
        with open(f"{place}/to{turn}") as f:
            assert sorted([*left, f.read()]) == ["a", "b"]


@pytest.mark.parametrize("path", ["", "NULL", "/", "hdfs://nn", "hdfs://nn/", "file:/", "s3a://bucket/"])
def test_paths_that_name_no_directory_are_refused(path):
    with pytest.raises(MaintenanceError):
        normalise(path)


def test_paths_keep_their_text():
    assert normalise("/x/db//") == "/x/db"
    assert normalise("s3a://bucket/db/") == "s3a://bucket/db"
    assert literal("/x/a[1]*") == "/x/a\\[1\\]\\*"


def test_a_path_with_glob_letters_is_taken_literally(spark, place):
    write_rows(spark, spark.range(3), f"{place}/d[a]b/t{{1}}", 1)
    write_rows(spark, spark.range(9), f"{place}/dab/t1", 1)
    assert pw.list_files(spark, f"{place}/d[a]b").count() == 1
    assert read_files(spark, f"{place}/d[a]b/t{{1}}").count() == 3
