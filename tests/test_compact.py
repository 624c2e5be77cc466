from __future__ import annotations

import os
import random
import shutil

import pytest
from conftest import SMALL
from helpers import files_in, leaf_dirs, rows_by_file, snapshot, visible_files, write_rows
from pyspark.sql import functions as F

import packwright as pw
import packwright.operators.compact as compact
from packwright.errors import InventoryError, LateFileError, MaintenanceError, PromotionError, VerificationError
from packwright.operators.verify import leaf_digest
from packwright.plans.compaction import job_plan, slice_plan
from packwright.session import JOB_SETTINGS
from packwright.sources.parquet import read_files
from packwright.storage import Storage


def events(spark):
    return spark.read.parquet(f"{SMALL}/events.parquet")


def checked(spark, base, **options):
    """Compact a database and check every invariant against a read of each file by itself."""
    rows, folders = rows_by_file(spark, base), leaf_dirs(base)
    report = {(r.table_name, r.partition): r for r in pw.compact_database(spark, base, **options).collect()}
    assert rows_by_file(spark, base) == rows
    assert leaf_dirs(base) == folders
    assert all(r.equal and r.files_after <= r.files_planned for r in report.values())
    assert sorted(os.listdir(os.path.dirname(base))) == [os.path.basename(base)]
    for (table, partition), r in report.items():
        place = f"{table}/{partition}".rstrip("/")
        assert len(files_in(base, place)) == r.files_after
    return report


def test_days_become_as_many_files_as_planned(spark, place):
    base = f"{place}/db"
    rows = events(spark).withColumn("dt", F.to_date("ts"))
    rows.repartition(16).write.partitionBy("dt").parquet(f"{base}/events")
    before = spark.read.parquet(f"{base}/events")
    schema, data = before.schema, sorted(map(str, before.collect()))
    report = checked(spark, base, target_bytes=8192)
    after = spark.read.parquet(f"{base}/events")
    assert after.schema == schema and sorted(map(str, after.collect())) == data
    assert all(r.files_before > r.files_after == r.files_planned for r in report.values())
    assert sum(r.rows_before for r in report.values()) == rows.count()


def test_two_levels_flat_and_default_target(spark, place):
    base = f"{place}/db/db"  # the base name occurs twice in the path
    line = spark.read.parquet(f"{SMALL}/lineitem.parquet")
    line.repartition(8).write.partitionBy("l_returnflag", "l_linestatus").parquet(f"{base}/lineitem")
    write_rows(spark, spark.read.parquet(f"{SMALL}/orders.parquet"), f"{base}/orders", 16)
    report = checked(spark, base)
    assert {r.files_after for r in report.values()} == {1}
    assert len(report) == 7 and report["orders", ""].files_before == 16


def test_odd_names_nested_types_and_null_partition(spark, place):
    base = f"{place}/db"
    rows = spark.range(400).selectExpr(
        "id",
        "element_at(array('01', '1', 'a b:c', 'x+y%z', NULL), CAST(id % 5 AS INT) + 1) AS k",
        "map('a', id, 'b', NULL) AS m",
        "named_struct('x', id, 'y', array(id, NULL)) AS s",
        "array(named_struct('z', id)) AS l",
        "CAST(id AS DECIMAL(38,18)) / 7 AS d",
        "DATE'2024-01-01' + CAST(id AS INT) AS day",
        "CAST(CAST(id AS STRING) AS BINARY) AS raw",
        "CAST(id AS DOUBLE) * -0.0 AS z",
        "CAST(NULL AS VOID) IS NULL AS flag",
        "id % 3 AS `dotted.name`",
    )
    rows.repartition(6).write.partitionBy("k").parquet(f"{base}/odd")
    report = checked(spark, base, target_bytes=8192)
    assert len(report) == 5 and all(r.files_after > 1 for r in report.values())


def test_opaque_and_mixed_children_and_root_files(spark, place):
    base = f"{place}/db"
    for name in ("opaque/20240101", "opaque/20240102/part", "mixed/k=1", "mixed/other", "mixed"):
        write_rows(spark, spark.range(50).withColumn("p", F.lit(name)), f"{base}/{name}", 5)
    report = checked(spark, base)
    assert {p for t, p in report if t == "mixed"} == {"", "k=1", "other"}
    assert {p for t, p in report if t == "opaque"} == {"20240101", "20240102/part"}


def test_partition_column_that_the_files_have_too(spark, place):
    base = f"{place}/db"
    write_rows(spark, spark.range(20).withColumn("k", F.lit("in file")), f"{base}/t/k=1", 4)
    checked(spark, base)


def test_a_column_only_some_files_have_is_kept(spark, place):
    base = f"{place}/db"
    write_rows(spark, spark.range(20), f"{base}/t", 2)
    write_rows(spark, spark.range(20, 40).withColumn("x", F.lit(1)), f"{base}/t", 2)
    checked(spark, base)
    assert spark.read.parquet(f"{base}/t").where("x = 1").count() == 20


def test_types_that_do_not_merge_stop_the_job(spark, place):
    base = f"{place}/db"
    write_rows(spark, spark.range(20), f"{base}/t", 2)
    write_rows(spark, spark.range(20).select(F.col("id").cast("string")), f"{base}/t", 2)
    before = snapshot(base)
    with pytest.raises(Exception):
        pw.compact_database(spark, base)
    assert snapshot(base) == before and os.listdir(place) == ["db"]


def test_files_without_rows_and_empty_directories(spark, place):
    base = f"{place}/db"
    nothing = spark.range(0).withColumn("x", F.lit("a"))
    write_rows(spark, nothing, f"{base}/t/k=0", 1)
    write_rows(spark, nothing, f"{base}/t/k=0", 1)
    write_rows(spark, spark.range(9).withColumn("x", F.lit("a")), f"{base}/t/k=1", 3)
    write_rows(spark, nothing, f"{base}/empty_flat", 1)
    os.makedirs(f"{base}/t/k=2")
    os.makedirs(f"{base}/no_files")
    report = checked(spark, base)
    assert report["t", "k=0"].files_before == 2 and report["t", "k=0"].files_after == 1
    assert report["t", "k=1"].rows_after == 9
    assert spark.read.parquet(f"{base}/empty_flat").columns == ["id", "x"]
    assert os.path.isdir(f"{base}/no_files")


def test_many_jobs_and_a_hot_partition(spark, place):
    base = f"{place}/db"
    hot = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.to_date("ts").cast("string"))
    rows = events(spark).withColumn("k", hot)
    rows.repartition(6).write.partitionBy("k").parquet(f"{base}/hive")
    os.makedirs(f"{base}/opaque")
    for name in os.listdir(f"{base}/hive"):
        if name.startswith("k="):
            shutil.copytree(f"{base}/hive/{name}", f"{base}/opaque/{name[2:]}")
    report = checked(spark, base, target_bytes=4096, job_files=12, slice_files=2)
    assert report["hive", "k=hot"].files_planned > 2
    assert report["hive", "k=hot"].files_planned == report["opaque", "hot"].files_planned


def test_duplicates_are_kept(spark, place):
    base = f"{place}/db"
    rows = spark.range(30).select((F.col("id") % 3).alias("v"))
    write_rows(spark, rows.unionAll(rows).unionAll(rows), f"{base}/t", 7)
    checked(spark, base, target_bytes=1024)


def test_twice_is_as_good_as_once(spark, place):
    base = f"{place}/db"
    write_rows(spark, events(spark), f"{base}/t/d=1", 16)
    first = checked(spark, base, target_bytes=8192)
    second = checked(spark, base, target_bytes=8192)
    assert second["t", "d=1"].files_before == first["t", "d=1"].files_after
    assert second["t", "d=1"].files_after <= first["t", "d=1"].files_after


def test_only_partitions_with_too_many_files(spark, place):
    base = f"{place}/db"
    write_rows(spark, spark.range(50), f"{base}/t/d=1", 1)
    write_rows(spark, spark.range(50), f"{base}/t/d=2", 6)
    write_rows(spark, spark.range(50), f"{base}/done", 1)
    write_rows(spark, spark.range(50), f"{base}/flat", 4)
    write_rows(spark, spark.range(50), f"{base}/mixed", 1)
    write_rows(spark, spark.range(50), f"{base}/mixed/sub", 3)
    rows, folders, before = rows_by_file(spark, base), leaf_dirs(base), set(visible_files(base))
    report = pw.compact_database(spark, base, only_if_files_exceed_plan=True).collect()
    done = {(r.table_name, r.partition) for r in report}
    assert done == {("t", "d=2"), ("flat", ""), ("mixed", ""), ("mixed", "sub")}
    assert rows_by_file(spark, base) == rows and leaf_dirs(base) == folders
    kept = before & set(visible_files(base))
    assert {os.path.dirname(f) for f in kept} == {"t/d=1", "done"}
    assert len(visible_files(base)) == 6 and os.listdir(place) == ["db"]
    again = pw.compact_database(spark, base, only_if_files_exceed_plan=True)
    assert again.count() == 0 and len(visible_files(base)) == 6


def test_named_tables_only(spark, place):
    base = f"{place}/db"
    for name in ("a", "b"):
        write_rows(spark, spark.range(50), f"{base}/{name}", 4)
    before = snapshot(f"{base}/b")
    report = pw.compact_database(spark, base + "/", tables=["a"]).collect()
    assert {r.table_name for r in report} == {"a"}
    assert len(visible_files(f"{base}/a")) == 1 and snapshot(f"{base}/b") == before
    with pytest.raises(Exception):
        pw.compact_database(spark, base, tables=["a", "absent"])
    assert len(visible_files(f"{base}/a")) == 1


def test_without_the_swap_the_copy_waits(spark, place):
    base = f"{place}/db"
    write_rows(spark, spark.range(50), f"{base}/t", 4)
    before = snapshot(base)
    pw.compact_database(spark, base, swap_in=False, codec="zstd")
    assert snapshot(base) == before
    (copy,) = visible_files(f"{base}_bkup")
    assert copy.startswith("t/") and copy.endswith(".zstd.parquet")
    with pytest.raises(MaintenanceError):
        pw.compact_database(spark, base)
    pw.promote(spark, base)
    assert len(visible_files(base)) == 1 and os.listdir(place) == ["db"]


@pytest.mark.parametrize("how", ["empty", "loose file", "log", "absent", "staging", "retired", "text"])
def test_refused_before_anything_is_written(spark, place, how):
    base = f"{place}/db"
    os.makedirs(base)
    if how != "empty":
        write_rows(spark, spark.range(5), f"{base}/t", 2)
    if how == "loose file":
        name = files_in(f"{base}/t")[0]
        shutil.copy(f"{base}/t/{name}", f"{base}/{name}")
    if how == "log":
        os.makedirs(f"{base}/t/_delta_log")
    if how == "staging":
        os.makedirs(f"{base}_bkup")
    if how == "retired":
        os.makedirs(f"{base}_old")
    if how == "text":
        with open(f"{base}/t/notes.txt", "w") as f:
            f.write("not parquet")
    before, beside = snapshot(base), os.listdir(place)
    with pytest.raises(Exception) as failure:
        pw.compact_database(spark, base + "x" if how == "absent" else base)
    if how in ("empty", "loose file"):
        assert failure.type is InventoryError
    assert snapshot(base) == before and os.listdir(place) == beside


def test_a_late_file_stops_the_swap(spark, place, monkeypatch):
    base = f"{place}/db"
    write_rows(spark, spark.range(50), f"{base}/t", 4)
    rewrite = compact._rewrite_table

    def late(spark_, *rest):
        done = rewrite(spark_, *rest)
        write_rows(spark_, spark_.range(50, 60), f"{base}/t", 1)
        return done

    monkeypatch.setattr(compact, "_rewrite_table", late)
    with pytest.raises(InventoryError):
        pw.compact_database(spark, base)
    assert spark.read.parquet(f"{base}/t").count() == 60
    assert os.listdir(place) == ["db"]


@pytest.mark.parametrize("partition", ["", "/d=1", "/x y"])
def test_a_file_that_comes_during_the_swap_undoes_it(spark, place, monkeypatch, partition):
    base = f"{place}/db"
    write_rows(spark, spark.range(50), f"{base}/t{partition}", 4)
    write_rows(spark, spark.range(7), f"{base}/u", 2)
    real = compact.swap

    def late(storage, live, pairs):
        if len(visible_files(f"{base}/t")) == 4:
            write_rows(spark, spark.range(50, 60), f"{base}/t{partition}", 1)
        real(storage, live, pairs)

    monkeypatch.setattr(compact, "swap", late)
    with pytest.raises(LateFileError):
        pw.compact_database(spark, base)
    assert spark.read.parquet(f"{base}/t{partition}").count() == 60
    assert len(visible_files(f"{base}/t")) == 5 and spark.read.parquet(f"{base}/u").count() == 7
    assert sorted(os.listdir(place)) == ["db", "db_bkup"]


def test_neighbours_with_working_names_are_left_alone(spark, place):
    for name in ("t", "t__by_number", "t__blank"):
        write_rows(spark, spark.range(50), f"{place}/db/{name}/20240101", 4)
    write_rows(spark, spark.range(0), f"{place}/db/t/20240102", 1)
    pw.compact_database(spark, f"{place}/db")
    for name in ("t", "t__by_number", "t__blank"):
        assert spark.read.parquet(f"{place}/db/{name}/20240101").count() == 50
    assert sorted(os.listdir(f"{place}/db/t")) == ["20240101", "20240102"]


@pytest.mark.parametrize("damage", ["lost", "doubled", "partition"])
def test_a_wrong_copy_is_never_swapped_in(spark, place, monkeypatch, damage):
    base = f"{place}/db"
    write_rows(spark, spark.range(50), f"{base}/t/d=1", 4)
    write_rows(spark, spark.range(50), f"{base}/t/d=2", 4)
    before = snapshot(base)
    placed = compact._placed

    def damaged(*args):
        rows = placed(*args)
        if damage == "lost":
            return rows.where("id <> 7")
        if damage == "doubled":
            return rows.unionAll(rows.where("id = 7"))
        return rows.where("d = '1'")

    monkeypatch.setattr(compact, "_placed", damaged)
    with pytest.raises(VerificationError):
        pw.compact_database(spark, base)
    assert snapshot(base) == before and os.listdir(place) == ["db"]


def test_a_swap_that_fails_half_way_is_undone(spark, place, monkeypatch):
    base = f"{place}/db"
    for name in ("a", "b"):
        write_rows(spark, spark.range(50), f"{base}/{name}", 4)
    before = snapshot(base)
    rename = Storage.rename

    def failing(self, source, target):
        if source == f"{base}_bkup/b":
            raise PromotionError("no")
        rename(self, source, target)

    monkeypatch.setattr(Storage, "rename", failing)
    with pytest.raises(PromotionError):
        pw.compact_database(spark, base)
    assert snapshot(base) == before and os.listdir(place) == ["db"]


def test_access_rights_stay(spark, place):
    base = f"{place}/db"
    for name in ("plain/d=1", "opaque/20240101", "flat"):
        write_rows(spark, spark.range(50), f"{base}/{name}", 4)
    modes = {"plain": 0o2770, "plain/d=1": 0o2750, "opaque": 0o755, "opaque/20240101": 0o700, "flat": 0o2770}
    for name, mode in modes.items():
        os.chmod(f"{base}/{name}", mode)
    pw.compact_database(spark, base)
    assert {n: os.stat(f"{base}/{n}").st_mode & 0o7777 for n in modes} == modes
    pw.compact_table(spark, f"{base}/plain", f"{place}/out")
    os.chmod(f"{base}/plain", 0o2710)
    pw.promote(spark, f"{base}/plain", f"{place}/out")
    assert os.stat(f"{base}/plain").st_mode & 0o7777 == 0o2710
    assert os.stat(f"{base}/plain/d=1").st_mode & 0o7777 == 0o2750


@pytest.mark.parametrize("name, stops", [("_meta", True), (".notes", True), ("d=1/.index", True), ("_temporary", False), (".hive-staging_1", False)])
def test_a_hidden_folder_that_would_vanish_stops_the_job(spark, place, name, stops):
    base = f"{place}/db"
    write_rows(spark, spark.range(50), f"{base}/t/d=1", 4)
    os.makedirs(f"{base}/t/{name}")
    before = snapshot(base)
    if stops:
        with pytest.raises(MaintenanceError, match="hidden"):
            pw.compact_database(spark, base)
        assert snapshot(base) == before and os.path.isdir(f"{base}/t/{name}") and os.listdir(place) == ["db"]
    else:
        pw.compact_database(spark, base)
        assert len(visible_files(base)) == 1


def _killed(monkeypatch, renames):
    """From now on the process 'ends' after so many renames of data: no clean-up of ours runs."""
    rename, left = Storage.rename, [renames]

    class End(BaseException):
        pass

    def until(self, source, target):
        if not source.endswith(".tmp"):
            if left[0] == 0:
                raise End
            left[0] -= 1
        rename(self, source, target)

    monkeypatch.setattr("packwright.storage.RENAME_THREADS", 1)
    monkeypatch.setattr(Storage, "rename", until)
    return End


@pytest.mark.parametrize("forward", [False, True])
def test_a_swap_cut_off_after_any_rename_can_be_recovered(spark, place, monkeypatch, forward):
    for renames in range(5):
        base = f"{place}/{renames}/db"
        for name in ("t", "u"):
            write_rows(spark, spark.range(30), f"{base}/{name}", 4)
        rows, files = rows_by_file(spark, base), set(visible_files(base))
        with monkeypatch.context() as patch:
            end = _killed(patch, renames)
            if renames < 4:
                with pytest.raises(end):
                    pw.compact_database(spark, base)
            else:  # killed once all is renamed, before the journal goes
                patch.setattr(compact, "finish_swap", lambda *a: (_ for _ in ()).throw(end()))
                with pytest.raises(end):
                    pw.compact_database(spark, base)
        with pytest.raises(MaintenanceError):
            pw.compact_database(spark, base)
        pw.recover(spark, base, forward=forward)
        assert rows_by_file(spark, base) == rows
        assert (set(visible_files(base)) == files) == (not forward)
        assert len(visible_files(base)) == (2 if forward else 8)
        left = {"db_old"} if forward else {"db_bkup"}
        assert set(os.listdir(f"{place}/{renames}")) - {"db"} <= left | {"db_bkup"}
        assert pw.recover(spark, base) == []


def test_the_callers_settings_come_back(spark, place):
    write_rows(spark, spark.range(50), f"{place}/db/t", 4)
    keys = [*JOB_SETTINGS, "spark.sql.files.maxPartitionBytes"]
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        pw.compact_database(spark, f"{place}/db")
        assert spark.conf.get("spark.sql.files.ignoreCorruptFiles") == "true"
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
    assert {k: spark.conf.get(k) for k in keys} == before


def test_a_corrupt_file_stops_the_job_even_if_the_session_would_skip_it(spark, place):
    base = f"{place}/db"
    write_rows(spark, spark.range(500), f"{base}/t", 4)
    victim = f"{base}/t/{files_in(f'{base}/t')[0]}"
    with open(victim, "r+b") as f:
        f.truncate(os.path.getsize(victim) // 2)
    before = snapshot(base)
    spark.conf.set("spark.sql.files.ignoreCorruptFiles", "true")
    try:
        with pytest.raises(Exception):
            pw.compact_database(spark, base)
    finally:
        spark.conf.unset("spark.sql.files.ignoreCorruptFiles")
    assert snapshot(base) == before


def test_catalog_tables_see_the_new_files(spark, place):
    write_rows(spark, spark.range(50), f"{place}/db/t", 4)
    spark.sql(f"CREATE TABLE refresh_me USING parquet LOCATION '{place}/db/t'")
    try:
        assert spark.table("refresh_me").count() == 50
        pw.compact_database(spark, f"{place}/db", refresh=["refresh_me"])
        assert spark.table("refresh_me").count() == 50
    finally:
        spark.sql("DROP TABLE refresh_me")


def test_one_table_to_a_new_place(spark, place):
    write_rows(spark, spark.range(50), f"{place}/t", 4)
    before = snapshot(f"{place}/t")
    pw.compact_table(spark, f"{place}/t", f"{place}/v2")
    assert snapshot(f"{place}/t") == before and len(visible_files(f"{place}/v2")) == 1
    for out in (f"{place}/v2", f"{place}/t", f"{place}/t/inside"):
        with pytest.raises(MaintenanceError):
            pw.compact_table(spark, f"{place}/t", out)
    with pytest.raises(MaintenanceError):
        pw.compact_table(spark, f"{place}/t", f"{place}/v3", target_bytes=0)


def _job(spark, table, target, job_files=8192, slice_files=2048, groups=1):
    scan = read_files(spark, table)
    parent, name = table.rsplit("/", 1)
    slices = slice_plan(pw.list_files(spark, parent, [name]), target, slice_files)
    plan = job_plan(slices, leaf_digest(scan, "rows"), groups, job_files, target)
    return scan, plan


def _explained(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_a_job_is_one_shuffle_and_a_small_broadcast(spark, place, capsys):
    rows = events(spark).withColumn("dt", F.to_date("ts"))
    rows.repartition(4).write.partitionBy("dt").parquet(f"{place}/t")
    scan, plan = _job(spark, f"{place}/t", 8192)
    plan = spark.createDataFrame(plan.collect(), plan.schema)
    moved = compact._placed(scan, plan, False, ["dt"]).repartitionById(8, F.col("__pw_task"))
    text = _explained(moved, capsys)
    assert text.count("Exchange") - text.count("BroadcastExchange") == 1
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "Python" not in text


@pytest.mark.parametrize("named", [200_000, 0])
def test_a_job_reads_its_own_files_only(spark, place, monkeypatch, named):
    monkeypatch.setattr(compact, "NAMED_FILES", named)
    hot = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.to_date("ts").cast("string"))
    events(spark).withColumn("k", hot).repartition(4).write.partitionBy("k").parquet(f"{place}/t")
    scan, plan = _job(spark, f"{place}/t", 4096, job_files=8, slice_files=1, groups=4)
    sources = compact._Sources(scan, pw.list_files(spark, place, ["t"]), f"{place}/t")
    rows = plan.collect()
    assert any(not compact._whole(r) for r in rows)
    seen = 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(4 << 20))  # one file per task
    try:
        whole = scan.rdd.getNumPartitions()
        for job in {r.job for r in rows}:
            part = sources.of_job([r for r in rows if r.job == job])
            seen += part.count()
            assert 0 < part.rdd.getNumPartitions() < whole / 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen == 1000


def test_many_jobs_of_a_mixed_table(spark, place):
    base = f"{place}/db"
    for name in ("t", "t/k=1", "t/k=1/deep", "t/x y"):
        write_rows(spark, events(spark).limit(300), f"{base}/{name}", 5)
    report = checked(spark, base, target_bytes=4096, job_files=6, slice_files=2)
    assert len(report) == 4


def test_whole_directories_are_renamed_not_their_files(spark, place, monkeypatch):
    base, moved, rename = f"{place}/db", [], Storage.rename
    for day in range(12):
        write_rows(spark, events(spark).limit(400), f"{base}/t/202401{day:02d}", 3)
    monkeypatch.setattr(Storage, "rename", lambda self, a, b: (moved.append(b), rename(self, a, b)))
    pw.compact_table(spark, f"{base}/t", f"{place}/out", target_bytes=4096)
    assert sorted(moved) == [f"{place}/out/202401{day:02d}" for day in range(12)]
    assert len(visible_files(f"{place}/out")) > 12
    assert rows_by_file(spark, f"{place}/out") == rows_by_file(spark, f"{base}/t")


@pytest.mark.parametrize("seed", range(4))
def test_random_databases(spark, place, seed):
    rng = random.Random(seed)
    base = f"{place}/db"
    for table in range(rng.randint(1, 3)):
        style = rng.choice(["flat", "one", "two", "opaque", "mixed"])
        leaves = {
            "flat": [""],
            "one": [f"k={rng.randint(0, 99):02d}" for _ in range(3)],
            "two": [f"a={i}/b={rng.choice('xyz')}" for i in range(3)],
            "opaque": [f"2024{rng.randint(1, 12):02d}" for _ in range(3)],
            "mixed": ["", "k=1", "2024/01"],
        }[style]
        for leaf in set(leaves):
            rows = spark.range(rng.choice([0, 1, 2, 40, 700])).selectExpr(
                f"id % {rng.randint(1, 50)} AS v",
                "IF(id % 3 = 0, NULL, map(CAST(id AS STRING), array(id, NULL))) AS m",
                "named_struct('a', id, 'b', IF(id % 2 = 0, NULL, repeat('x', CAST(id % 40 AS INT)))) AS s",
            )
            rows = rows.unionAll(rows) if rng.random() < 0.5 else rows
            write_rows(spark, rows, f"{base}/t{table}/{leaf}".rstrip("/"), rng.randint(1, 9))
    checked(
        spark,
        base,
        target_bytes=rng.choice([512, 4096, 1 << 27]),
        job_files=rng.choice([2, 8192]),
        slice_files=rng.choice([1, 2048]),
    )
