from __future__ import annotations

import datetime
import os
import random
import uuid

import pytest
from conftest import SMALL
from helpers import snapshot, write_rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

import packwright as pw
from packwright.errors import MaintenanceError, ReplacementError
from packwright.operators.stage_load import stage_load
from packwright.session import settings
from packwright.sinks import targets
from packwright.sinks.targets import PathTarget, TableTarget
from packwright.sources.formats import checked_identifier, read_prefix
from packwright.workloads import export

SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("price", T.DecimalType(8, 2)),
    ]
)


def text_file(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("".join(line + "\n" for line in lines))


def loaded(spark, place, fmt="csv", prefix="in/", schema=SCHEMA, **options):
    target = pw.PathTarget(f"{place}/stage", schema)
    count = pw.stage_load(spark, place, prefix, fmt, target, options or None)
    rows = spark.read.parquet(f"{place}/stage").collect()
    assert count == len(rows)
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0]))


def with_old_rows(spark, place):
    old = spark.range(7).select(F.col("id").cast("int"), F.lit("old").alias("name"))
    write_rows(spark, old.withColumn("price", F.lit(1).cast("decimal(8,2)")), f"{place}/stage", 2)
    return snapshot(f"{place}/stage")


def test_quotes_are_doubled_and_empty_fields_are_null(spark, place):
    text_file(f"{place}/in/a.csv", ['1,"a ""q"" b, c",2.50', "2,,", "3,plain,0.01"])
    with_old_rows(spark, place)
    got = loaded(spark, place)
    assert [(i, n, None if p is None else str(p)) for i, n, p in got] == [
        (1, 'a "q" b, c', "2.50"),
        (2, None, None),
        (3, "plain", "0.01"),
    ]
    assert sorted(os.listdir(place)) == ["in", "stage"]


@pytest.mark.parametrize(
    "bad",
    ["x,bad int,1.00", "4,short", "4,long,1.00,5", "4,wide,123456789.00"],
)
def test_a_bad_record_leaves_the_old_rows(spark, place, bad):
    text_file(f"{place}/in/a.csv", ["1,a,1.00"] * 50)
    text_file(f"{place}/in/b.csv", ["2,b,1.00", bad])
    before = with_old_rows(spark, place)
    with pytest.raises(Exception):
        loaded(spark, place)
    assert snapshot(f"{place}/stage") == before
    assert sorted(os.listdir(place)) == ["in", "stage"]


def test_a_caller_cannot_make_the_load_skip_bad_records(spark, place):
    text_file(f"{place}/in/a.csv", ["x,bad int,1.00"])
    with pytest.raises(Exception):
        loaded(spark, place, mode="DROPMALFORMED")


def test_bad_json_leaves_the_old_rows(spark, place):
    text_file(f"{place}/in/a.json", ['{"id": 1, "name": "a", "price": 1}', '{"id": "x"}'])
    before = with_old_rows(spark, place)
    with pytest.raises(Exception):
        loaded(spark, place, "json")
    assert snapshot(f"{place}/stage") == before


def test_json_goes_by_name(spark, place):
    text_file(f"{place}/in/a.json", ['{"price": 1.5, "id": 1, "more": true}', '{"name": "n"}'])
    got = loaded(spark, place, "json")
    assert [(i, n, p and str(p)) for i, n, p in got] == [(1, None, "1.50"), (None, "n", None)]


def test_delimited_text_and_reader_options(spark, place):
    text_file(f"{place}/in/a.txt", ['1|a "quoted|2.00'])
    assert [(i, n) for i, n, _ in loaded(spark, place, "delimited")] == [(1, 'a "quoted')]
    text_file(f"{place}/h/a.csv", ["id;name;price", "5;x;1.00"])
    assert [(i, n) for i, n, _ in loaded(spark, place, prefix="h/", header="true", sep=";")] == [(5, "x")]


def test_microseconds_survive_text(spark, place):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for fmt in ("csv", "json"):
        export(events, fmt, f"{place}/{fmt}")
        target = pw.PathTarget(f"{place}/stage", events.schema)
        assert pw.stage_load(spark, place, f"{fmt}/", fmt, target) == 1000
        stage = spark.read.parquet(f"{place}/stage")
        assert stage.schema == events.schema
        assert stage.exceptAll(events).count() == 0 and events.exceptAll(stage).count() == 0


def test_a_prefix_is_text_and_reaches_into_directories(spark, place):
    for name in ("load_1.csv", "load_2/x/part.csv", "load_2/dt=01/part.csv", "load_x.csv"):
        text_file(f"{place}/in/{name}", [f"1,{name},1.00"])
    for name in ("other.csv", "sub/load_9.csv", "loadX.csv"):
        text_file(f"{place}/in/{name}", [f"2,{name},1.00"])
    assert len(loaded(spark, place, prefix="in/load_")) == 4
    text_file(f"{place}/in/l*d/a.csv", ["3,star,1.00"])
    assert [i for i, *_ in loaded(spark, place, prefix="in/l*d")] == [3]


def test_a_prefix_without_files_leaves_the_old_rows(spark, place):
    before = with_old_rows(spark, place)
    with pytest.raises(Exception):
        loaded(spark, place, prefix="absent/")
    assert snapshot(f"{place}/stage") == before


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_columnar_files_go_by_position(spark, place, fmt):
    rows = spark.range(9).selectExpr("CAST(id AS INT) c0", "CAST(id AS STRING) id", "CAST(1 AS DECIMAL(8,2)) z")
    rows.write.format(fmt).save(f"{place}/in")
    assert [(i, n) for i, n, _ in loaded(spark, place, fmt)] == [(i, str(i)) for i in range(9)]


@pytest.mark.parametrize(
    "columns",
    [["id"], ["'text' AS a", "'b' AS b", "1 AS c"], ["id + 5000000000 AS a", "'b' AS b", "1 AS c"]],
)
def test_columnar_files_that_do_not_fit_leave_the_old_rows(spark, place, columns):
    spark.range(9).selectExpr(*columns).write.parquet(f"{place}/in")
    before = with_old_rows(spark, place)
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        with pytest.raises(Exception):
            loaded(spark, place, "parquet")
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert snapshot(f"{place}/stage") == before


def test_null_where_none_is_allowed_leaves_the_old_rows(spark, place):
    strict = T.StructType([T.StructField("id", T.IntegerType(), False), *SCHEMA.fields[1:]])
    text_file(f"{place}/in/a.csv", ["1,a,1.00", ",b,1.00"])
    before = with_old_rows(spark, place)
    with pytest.raises(Exception):
        loaded(spark, place, schema=strict)
    assert snapshot(f"{place}/stage") == before
    text_file(f"{place}/in/a.csv", ["1,a,1.00", "2,b,1.00"])
    assert len(loaded(spark, place, schema=strict)) == 2


def test_catalog_table_keeps_its_definition(spark, place):
    spark.sql(
        f"CREATE TABLE stage_it (id INT, name STRING, price DECIMAL(8,2)) USING orc "
        f"COMMENT 'stays' LOCATION '{place}/table'"
    )
    try:
        spark.sql("INSERT INTO stage_it VALUES (9, 'old', 1)")
        text_file(f"{place}/in/a.csv", ["1,a,1.00", "2,b,1.00"])
        assert pw.stage_load(spark, place, "in/", "csv", pw.TableTarget("stage_it")) == 2
        assert sorted(r.id for r in spark.table("stage_it").collect()) == [1, 2]
        text_file(f"{place}/in/b.csv", ["x,b,1.00"])
        with pytest.raises(Exception):
            pw.stage_load(spark, place, "in/", "csv", pw.TableTarget("stage_it"))
        assert sorted(r.id for r in spark.table("stage_it").collect()) == [1, 2]
        text = spark.sql("SHOW CREATE TABLE stage_it").first()[0]
        assert "stays" in text and "orc" in text.lower()
    finally:
        spark.sql("DROP TABLE stage_it")


def test_every_partition_of_a_table_is_replaced(spark, place):
    spark.sql(
        f"CREATE TABLE stage_parts (id INT, price DECIMAL(8,2), name STRING) USING parquet "
        f"PARTITIONED BY (name) LOCATION '{place}/table'"
    )
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        spark.sql("INSERT INTO stage_parts VALUES (9, 1, 'old')")
        text_file(f"{place}/in/a.csv", ["1,1.00,a", "2,1.00,b"])
        assert pw.stage_load(spark, place, "in/", "csv", pw.TableTarget("stage_parts")) == 2
        assert sorted(r.name for r in spark.table("stage_parts").collect()) == ["a", "b"]
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
        spark.sql("DROP TABLE stage_parts")


@pytest.mark.parametrize("name", ["t; drop table x", "a.b.c.d", "", "1t", "t--", "t'"])
def test_names_that_are_not_plain_are_refused(name):
    with pytest.raises(MaintenanceError):
        checked_identifier(name)


def test_unknown_formats_and_left_over_copies_are_refused(spark, place):
    with pytest.raises(MaintenanceError):
        loaded(spark, place, "xml")
    os.makedirs(f"{place}/stage_load")
    text_file(f"{place}/in/a.csv", ["1,a,1.00"])
    with pytest.raises(MaintenanceError):
        loaded(spark, place)
    assert os.path.isdir(f"{place}/stage_load")


def test_database_settings_are_handed_on_and_not_shown():
    """The JDBC calls as the writer gets them; no database is started for a test."""
    target = pw.JdbcTarget("jdbc:x://h/d", "stage.t", {"password": "hidden"}, connections=3)
    assert "hidden" not in repr(target)

    class Writer:
        def __init__(self):
            self.seen = {}

        def mode(self, mode):
            self.seen["mode"] = mode
            return self

        def options(self, **options):
            self.seen.update(options)
            return self

    class Rows:
        write = Writer()

    got = target._writer(Rows()).seen
    assert got["mode"] == "overwrite" and got["truncate"] == "true" and got["numPartitions"] == 3


def test_too_long_text_leaves_the_table(spark, place):
    name = f"short_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (k BIGINT, v VARCHAR(3)) USING parquet LOCATION '{place}/t'")
    spark.sql(f"INSERT INTO {name} VALUES (1, 'abc')")
    before = snapshot(f"{place}/t")
    spark.sql("SELECT 2L AS k, 'too long' AS v").write.json(f"{place}/source/rows")
    with pytest.raises(MaintenanceError):
        stage_load(spark, f"{place}/source", "rows", "json", TableTarget(name))
    assert snapshot(f"{place}/t") == before
    spark.sql("SELECT 2L AS k, 'fit' AS v").write.mode("overwrite").json(f"{place}/source/rows")
    assert stage_load(spark, f"{place}/source", "rows", "json", TableTarget(name)) == 1
    assert [tuple(r) for r in spark.table(name).collect()] == [(2, "fit")]


def test_options_and_prefixes_that_would_lose_or_mix_rows(spark, place):
    rows = spark.range(5).toDF("id")
    rows.write.parquet(f"{place}/orders_2024")
    rows.write.parquet(f"{place}/orders_stage")
    before = snapshot(f"{place}/orders_stage")
    target = PathTarget(f"{place}/orders_stage", rows.schema)
    with pytest.raises(MaintenanceError, match="covers"):
        stage_load(spark, place, "orders_", "parquet", target)
    with pytest.raises(MaintenanceError, match="not allowed"):
        stage_load(spark, place, "orders_2024", "parquet", target, {"ignoreCorruptFiles": "true"})
    assert snapshot(f"{place}/orders_stage") == before


def test_timestamps_with_a_blank(spark, place):
    spark.sql("SELECT '2024-01-01 10:00:00.123456' AS t").write.text(f"{place}/source/a")
    spark.sql("SELECT '2024-01-01T10:00:00.123456' AS t").write.text(f"{place}/source/b")
    schema = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS t").schema
    spark.createDataFrame([], schema).write.parquet(f"{place}/stage")
    stage_load(spark, f"{place}/source", "", "csv", PathTarget(f"{place}/stage", schema))
    assert {str(r.t) for r in spark.read.parquet(f"{place}/stage").collect()} == {"2024-01-01 10:00:00.123456"}


def _put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)


def _read(spark, place, schema, options=None, fmt="csv"):
    rows = read_prefix(spark, place, "in/", fmt, T.StructType.fromDDL(schema), options)
    return sorted(map(tuple, rows.collect()), key=repr)


def test_blank_is_null_and_quoted_empty_is_empty(spark, place):
    _put(f"{place}/in/a.csv", '1,"",x\n2,,"y ""z"""\r\n3," "," q"\n')
    assert _read(spark, place, "i int, s string, t string") == [(1, "", "x"), (2, None, 'y "z"'), (3, " ", " q")]
    _put(f"{place}/in/a.csv", '"",,x\n')
    with pytest.raises(Exception, match="[Mm]alformed"):
        _read(spark, place, "i int, s string, t string")


def test_a_line_break_in_quotes_needs_to_be_announced(spark, place):
    _put(f"{place}/in/a.csv", '1,"two\nlines"\n2,b\n')
    with pytest.raises(Exception, match="not closed"):
        _read(spark, place, "i int, s string")
    assert _read(spark, place, "i int, s string", {"multi_line": "true"}) == [(1, "two\nlines"), (2, "b")]
    _put(f"{place}/in/b.csv", '3,"never closed\n4,d\n')
    with pytest.raises(Exception, match="not closed"):
        _read(spark, place, "i int, s string", {"multi_line": "true"})


@pytest.mark.parametrize("split", [7, 40, 1000, 1 << 27])
@pytest.mark.parametrize("header", [False, True])
def test_records_across_splits_are_those_of_the_whole_file(spark, place, split, header):
    rng = random.Random(split)
    value = lambda: "".join(rng.choice('ab,"\n\r\n é ') for _ in range(rng.choice([0, 1, 5, 60])))
    want = []
    for name in "abc":
        rows = [(i, value().rstrip("\r") if rng.random() < 0.9 else None, value()) for i in range(rng.randint(1, 60))]
        quoted = lambda v: "" if v is None else '"' + v.replace('"', '""') + '"'
        lines = [f"{i},{quoted(s)},{quoted(t)}" for i, s, t in rows]
        head = ['i,"a\nheader","of ""lines"""'] if header else []
        _put(f"{place}/in/{name}.csv", "\n".join([*head, *lines]) + rng.choice(["", "\n", "\n\n"]))
        want += rows
    with settings(spark, {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}):
        got = _read(spark, place, "i int, s string, t string", {"multi_line": "true", "header": str(header)})
    assert got == sorted(want, key=repr)


def test_other_quotes_and_escapes(spark, place):
    _put(f"{place}/in/a.csv", "1;'it\\'s\nso'\n2;'a\\\\'\n3;b\n")
    options = {"sep": ";", "quote": "'", "escape": "\\", "multi_line": "true"}
    assert _read(spark, place, "i int, s string", options) == [(1, "it's\nso"), (2, "a\\"), (3, "b")]


def test_a_header_without_line_breaks(spark, place):
    _put(f"{place}/in/a.csv", "i,s\n1,a\n")
    _put(f"{place}/in/b.csv", "i,s\n2,b\n")
    assert _read(spark, place, "i int, s string", {"header": "true"}) == [(1, "a"), (2, "b")]
    with pytest.raises(Exception):
        _read(spark, place, "i int, s string")


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_each_columnar_file_counts_by_its_own_order(spark, place, fmt):
    spark.sql("SELECT 1 AS c0, 2L AS c1").write.format(fmt).save(f"{place}/in/a")
    spark.sql("SELECT 3 AS c1, 4L AS c0").write.format(fmt).save(f"{place}/in/b")
    spark.sql("SELECT 5 AS x, 6L AS y").write.format(fmt).save(f"{place}/in/k=1")
    assert _read(spark, place, "p int, q bigint", fmt=fmt) == [(1, 2), (3, 4), (5, 6)]
    spark.sql("SELECT 7 AS c0").write.format(fmt).save(f"{place}/in/d")
    with pytest.raises(MaintenanceError, match="columns"):
        _read(spark, place, "p int, q bigint", fmt=fmt)


def test_fixed_widths(spark, place):
    _put(f"{place}/in/a.txt", "001ab  2024-01-05\n 17    2024-02-29\r\n   é c           \n")
    got = _read(spark, place, "i int, s string, d date", {"widths": "3,4,10"}, "fixed")
    day = datetime.date
    assert got == sorted([(1, "ab", day(2024, 1, 5)), (17, None, day(2024, 2, 29)), (None, "é c", None)], key=repr)
    for bad, text in [({"widths": "3,4"}, "x"), ({"widths": "3,4,10"}, "too short\n"), ({"widths": "1,1,10"}, "xy2024-01-05\n")]:
        _put(f"{place}/in/a.txt", text)
        with pytest.raises(Exception):
            with settings(spark, {"spark.sql.ansi.enabled": "true"}):
                _read(spark, place, "i int, s string, d date", bad, "fixed")


def test_a_failure_while_rows_are_replaced_says_so(spark, place, monkeypatch):
    _put(f"{place}/in/a.csv", "1,a\n")
    name = f"stage_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} (i int, s string) USING json LOCATION '{place}/stage'")
    spark.sql(f"INSERT INTO {name} VALUES (9, 'old')")
    monkeypatch.setattr(targets, "_require_count", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(ReplacementError):
        pw.stage_load(spark, place, "in/", "csv", pw.TableTarget(name))
    monkeypatch.undo()
    real = spark.table
    with monkeypatch.context() as patch:
        patch.setattr(pw.TableTarget, "rehearse", lambda self, s, p: (_ for _ in ()).throw(RuntimeError("no")))
        with pytest.raises(MaintenanceError, match="untouched"):
            pw.stage_load(spark, place, "in/", "csv", pw.TableTarget(name))
    assert pw.stage_load(spark, place, "in/", "csv", pw.TableTarget(name)) == 1
    assert [tuple(r) for r in real(name).collect()] == [(1, "a")]
    spark.sql(f"DROP TABLE {name}")
