from __future__ import annotations

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import packwright as pw
from packwright.errors import MaintenanceError
from packwright.functions.fingerprint import combined_sum, hash_sums, row_hash


def fingerprint(df):
    hashed = df.select(row_hash(df.schema).alias("h"))
    return hashed.agg(*hash_sums("h")).select(combined_sum().alias("f")).first().f


def sql(spark, text):
    return fingerprint(spark.sql(text))


@pytest.mark.parametrize(
    ("one", "other"),
    [
        ("SELECT 1 a, CAST(NULL AS INT) b", "SELECT CAST(NULL AS INT) a, 1 b"),
        ("SELECT 0.0D a", "SELECT -0.0D a"),
        ("SELECT '' a", "SELECT CAST(NULL AS STRING) a"),
        ("SELECT array(1, NULL) a", "SELECT array(NULL, 1) a"),
        ("SELECT array(1) a", "SELECT array(1, NULL) a"),
        ("SELECT CAST(array() AS ARRAY<INT>) a", "SELECT CAST(NULL AS ARRAY<INT>) a"),
        ("SELECT map('k', 1) a", "SELECT map('k', 2) a"),
        ("SELECT map('k', 1) a", "SELECT map('l', 1) a"),
        ("SELECT map('k', CAST(NULL AS INT)) a", "SELECT CAST(map() AS MAP<STRING, INT>) a"),
        ("SELECT named_struct('x', 1, 'y', 2) a", "SELECT named_struct('x', 2, 'y', 1) a"),
        ("SELECT named_struct('x', CAST(NULL AS INT)) a", "SELECT CAST(NULL AS STRUCT<x: INT>) a"),
        ("SELECT array(array(1), array(2)) a", "SELECT array(array(1, 2)) a"),
        ("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00.000001' a", "SELECT TIMESTAMP_NTZ'2024-01-01' a"),
        ("SELECT array(-0.0D) a", "SELECT array(0.0D) a"),
    ],
)
def test_rows_that_differ_have_other_fingerprints(spark, one, other):
    assert sql(spark, one) != sql(spark, other)


def test_order_does_not_count_but_copies_do(spark):
    rows = spark.read.parquet(f"{SMALL}/events.parquet")
    assert fingerprint(rows) == fingerprint(rows.orderBy(F.desc("event_id")).repartition(5))
    assert fingerprint(rows) != fingerprint(rows.unionAll(rows.limit(2)))
    assert fingerprint(rows) != fingerprint(rows.unionAll(rows).unionAll(rows))


def test_the_sum_is_exact(spark):
    rows = spark.range(10_000)
    hashes = [r.h for r in rows.select(row_hash(rows.schema).alias("h")).collect()]
    assert int(fingerprint(rows)) == sum(h % (1 << 64) for h in hashes)


@pytest.mark.parametrize("damage", ["lost", "doubled", "changed", "moved"])
def test_damage_is_found_in_its_partition(spark, place, damage):
    rows = spark.range(100).select("id", (F.col("id") % 4).alias("k"), F.lit("x").alias("s"))
    victim = F.col("id") == 42
    damaged = {
        "lost": rows.where(~victim),
        "doubled": rows.unionAll(rows.where(victim)),
        "changed": rows.withColumn("s", F.when(victim, "y").otherwise(F.col("s"))),
        "moved": rows.withColumn("k", F.when(victim, 3).otherwise(F.col("k"))),
    }[damage]
    rows.write.partitionBy("k").parquet(f"{place}/a")
    damaged.write.partitionBy("k").parquet(f"{place}/b")
    report = pw.verify_compaction(spark, f"{place}/a", f"{place}/b").collect()
    wrong = {r.partition for r in report if not r.equal}
    assert wrong == ({"k=2", "k=3"} if damage == "moved" else {"k=2"})
    by_rows = pw.verify_compaction(spark, f"{place}/a", f"{place}/b", level="rows").collect()
    assert any(not r.equal for r in by_rows) == (damage != "changed")


def test_a_missing_or_extra_partition_is_not_equal(spark, place):
    rows = spark.range(10).select("id", (F.col("id") % 2).alias("k"))
    rows.write.partitionBy("k").parquet(f"{place}/a")
    rows.where("k = 0").write.partitionBy("k").parquet(f"{place}/b")
    for one, other in (("a", "b"), ("b", "a")):
        report = pw.verify_compaction(spark, f"{place}/{one}", f"{place}/{other}").collect()
        assert {r.partition: r.equal for r in report} == {"k=0": True, "k=1": False}


def test_other_columns_are_refused(spark, place):
    spark.range(3).write.parquet(f"{place}/a")
    spark.range(3).withColumn("x", F.lit(1)).write.parquet(f"{place}/b")
    with pytest.raises(MaintenanceError):
        pw.verify_compaction(spark, f"{place}/a", f"{place}/b")
    with pytest.raises(MaintenanceError):
        pw.verify_compaction(spark, f"{place}/a", f"{place}/a", level="some")
