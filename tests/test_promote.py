from __future__ import annotations

import os
import shutil
import uuid

import pytest
from helpers import snapshot, visible_files, write_rows

import packwright as pw
import packwright.operators.promote as promotion
from packwright.errors import BrokenSwapError, InventoryError, LateFileError, PromotionError, VerificationError
from packwright.operators.promote import SOURCES
from packwright.storage import Storage


@pytest.fixture
def pair(place):
    for name in ("db", "db_bkup"):
        os.makedirs(f"{place}/{name}/t")
        with open(f"{place}/{name}/t/f.parquet", "w") as f:
            f.write(name)
    return f"{place}/db"


def content(path):
    with open(f"{path}/t/f.parquet") as f:
        return f.read()


def test_the_copy_takes_the_place(spark, pair):
    pw.promote(spark, pair + "/")
    assert content(pair) == "db_bkup"
    assert os.listdir(os.path.dirname(pair)) == ["db"]


def test_the_old_tree_can_be_kept(spark, pair):
    pw.promote(spark, pair, keep_old=True)
    assert content(pair + "_old") == "db"
    with pytest.raises(PromotionError):
        pw.promote(spark, pair)


def test_without_a_copy_nothing_moves(spark, pair):
    before = snapshot(pair)
    with pytest.raises(PromotionError):
        pw.promote(spark, pair, pair + "_absent")
    with pytest.raises(PromotionError):
        pw.promote(spark, pair, pair + "/t")
    assert snapshot(pair) == before


def test_a_failed_second_rename_is_undone(spark, pair, monkeypatch):
    rename = Storage.rename

    def failing(self, source, target):
        if source.endswith("_bkup"):
            raise PromotionError("no")
        rename(self, source, target)

    monkeypatch.setattr(Storage, "rename", failing)
    with pytest.raises(PromotionError):
        pw.promote(spark, pair)
    assert content(pair) == "db" and content(pair + "_bkup") == "db_bkup"


def test_a_swap_that_cannot_be_undone_deletes_nothing(spark, pair, monkeypatch):
    rename = Storage.rename

    def failing(self, source, target):
        if source != pair and not source.endswith(".tmp"):
            raise PromotionError("no")
        rename(self, source, target)

    monkeypatch.setattr(Storage, "rename", failing)
    with pytest.raises(BrokenSwapError):
        pw.promote(spark, pair)
    monkeypatch.undo()
    assert content(pair + "_old") == "db" and content(pair + "_bkup") == "db_bkup"
    assert pw.recover(spark, pair) == [pair]
    assert content(pair) == "db"


def test_a_file_that_came_after_the_copy_stops_the_swap(spark, place):
    write_rows(spark, spark.range(50), f"{place}/t", 4)
    pw.compact_table(spark, f"{place}/t", f"{place}/copy")
    assert spark.read.parquet(f"{place}/copy").count() == 50
    write_rows(spark, spark.range(5), f"{place}/t", 1)
    before = snapshot(f"{place}/t")
    with pytest.raises(InventoryError):
        pw.promote(spark, f"{place}/t", f"{place}/copy")
    assert snapshot(f"{place}/t") == before and len(visible_files(f"{place}/copy")) == 1


@pytest.mark.parametrize("with_list", [True, False])
def test_a_file_that_comes_during_a_promotion_undoes_it(spark, place, monkeypatch, with_list):
    write_rows(spark, spark.range(50), f"{place}/t", 4)
    pw.compact_table(spark, f"{place}/t", f"{place}/copy")
    if not with_list:
        shutil.rmtree(f"{place}/copy/{SOURCES}")
    real = promotion.swap

    def late(storage, live, triples):
        write_rows(spark, spark.range(5), f"{place}/t", 1)
        real(storage, live, triples)

    monkeypatch.setattr(promotion, "swap", late)
    with pytest.raises(LateFileError):
        pw.promote(spark, f"{place}/t", f"{place}/copy")
    assert spark.read.parquet(f"{place}/t").count() == 55 and spark.read.parquet(f"{place}/copy").count() == 50
    assert sorted(os.listdir(place)) == ["copy", "t"]


def _catalog_table(spark, place, keys=()):
    name = f"t_{uuid.uuid4().hex}"
    rows = spark.range(60).selectExpr("id AS v", "IF(id % 4 = 0, NULL, concat('a b', id % 3)) AS k").repartition(6)
    writer = rows.write.partitionBy(*keys) if keys else rows.write
    writer.parquet(f"{place}/{name}")
    by = f"PARTITIONED BY ({', '.join(keys)})" if keys else ""
    spark.sql(f"CREATE TABLE {name} (v bigint, k string) USING parquet {by} LOCATION '{place}/{name}'")
    if keys:
        spark.sql(f"MSCK REPAIR TABLE {name}")
    return name, f"{place}/{name}"


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_a_catalog_table_is_pointed_at_the_copy(spark, place, keys):
    name, old = _catalog_table(spark, place, keys)
    rows, before = sorted(map(repr, spark.table(name).collect())), snapshot(old)
    report = pw.compact_catalog_table(spark, name, f"{place}/new's copy")
    assert report.where("not equal").isEmpty()
    spark.catalog.clearCache()
    assert sorted(map(repr, spark.table(name).collect())) == rows
    assert all("copy" in f for f in spark.table(name).inputFiles())
    assert len(spark.table(name).inputFiles()) == (4 if keys else 1)
    assert snapshot(old) == before
    assert sorted(f.split("/")[0] for f in os.listdir(place)) == sorted([name, "new's copy"])
    spark.sql(f"INSERT INTO {name} VALUES (1000, 'fresh')")
    assert snapshot(old) == before and spark.table(name).count() == 61
    spark.sql(f"DROP TABLE {name}")


def test_a_table_goes_back_if_a_partition_cannot_follow(spark, place, monkeypatch):
    name, old = _catalog_table(spark, place, ("k",))
    pw.compact_table(spark, old, f"{place}/copy")
    sql, seen = type(spark).sql, []

    def failing(self, query, *args, **kw):
        if "SET LOCATION" in query and "/copy" in query:
            seen.append(query)
            if len(seen) == 3:
                raise RuntimeError("no")
        return sql(self, query, *args, **kw)

    with monkeypatch.context() as patch:
        patch.setattr(type(spark), "sql", failing)
        with pytest.raises(RuntimeError):
            pw.promote_table(spark, name, f"{place}/copy")
    assert len(seen) == 3 and all("/copy" not in f for f in spark.table(name).inputFiles())
    assert spark.table(name).count() == 60
    spark.sql(f"DROP TABLE {name}")


def test_a_table_is_not_pointed_at_what_differs(spark, place):
    name, old = _catalog_table(spark, place)
    write_rows(spark, spark.table(name).where("v <> 7"), f"{place}/wrong", 1)
    with pytest.raises(VerificationError):
        pw.promote_table(spark, name, f"{place}/wrong")
    pw.compact_table(spark, old, f"{place}/copy")
    write_rows(spark, spark.table(name).limit(3), old, 1)
    with pytest.raises(InventoryError):
        pw.promote_table(spark, name, f"{place}/copy")
    spark.sql("CREATE OR REPLACE TEMP VIEW some_view AS SELECT 1 AS v")
    for bad in ("some_view", "no table", f"{name}; DROP TABLE x"):
        with pytest.raises(Exception):
            pw.promote_table(spark, bad, f"{place}/copy")
    with pytest.raises(PromotionError):
        pw.promote_table(spark, name, f"{old}/inside")
    assert all("/copy" not in f and "/wrong" not in f for f in spark.table(name).inputFiles())
    spark.sql(f"DROP TABLE {name}")


def test_recover_after_a_crash_between_the_renames(spark, pair):
    os.rename(pair, pair + "_old")
    assert pw.recover(spark, pair) == [pair]
    assert content(pair) == "db"
    assert pw.recover(spark, pair) == []


def test_recover_one_table_of_a_database(spark, pair):
    os.makedirs(f"{pair}_old/u")
    os.makedirs(f"{pair}/done")
    os.makedirs(f"{pair}_old/done")
    assert pw.recover(spark, pair) == [f"{pair}/u"]
    assert content(pair) == "db" and os.path.isdir(f"{pair}_old/done")


def test_only_the_leading_text_of_a_path_is_mapped():
    assert pw.map_path("/x/db/a/x/db/b", "/x/db/", "/x/db_bkup") == "/x/db_bkup/a/x/db/b"
    assert pw.map_path("/x/db", "/x/db", "/y/z") == "/y/z"
    for path, base, target in (
        ("/x/dbx/a", "/x/db", "/x/db_bkup"),
        ("/x/db/a", "/x/db", "/x/db/_bkup"),
        ("/x/db/a", "/x/db", "/x/db"),
    ):
        with pytest.raises(PromotionError):
            pw.map_path(path, base, target)
