from __future__ import annotations

import uuid

import pytest
from helpers import visible_files, write_rows

from packwright import cli
from packwright.cli import parser, run, settings_of, target_of


def test_compact(spark, place, capsys):
    write_rows(spark, spark.range(40), f"{place}/db/t/d=1", 5)
    run(spark, ["compact", "-p", f"{place}/db/"])
    assert "'files_before': 5, 'files_after': 1" in capsys.readouterr().out
    assert len(visible_files(f"{place}/db")) == 1


def test_load(spark, place, capsys):
    spark.range(5).write.csv(f"{place}/in")
    argv = ["load", "--root", place, "--prefix", "in/", "--format", "csv", "--path", f"{place}/out"]
    run(spark, [*argv, "--schema", "id BIGINT"])
    assert "{'rows': 5}" in capsys.readouterr().out
    assert spark.read.parquet(f"{place}/out").count() == 5
    with pytest.raises(SystemExit):
        run(spark, argv)


def test_arguments():
    for argv in ([], ["compact"], ["load", "--root", "x"]):
        with pytest.raises(SystemExit):
            parser().parse_args(argv)
    base = ["load", "--root", "r", "--prefix", "p", "--format", "csv"]
    with pytest.raises(SystemExit):
        target_of(parser().parse_args([*base, "--jdbc-table", "t"]))
    jdbc = [*base, "--jdbc-table", "t", "--jdbc-url", "jdbc:x:", "--jdbc-property", "user=a=b"]
    target = target_of(parser().parse_args(jdbc))
    assert (target.table, target.properties) == ("t", {"user": "a=b"})


def test_secrets_come_from_a_file(place):
    with open(f"{place}/p", "w") as f:
        f.write("# database\nuser=ann\npassword=a=b#c\n\n")
    base = ["load", "--root", "r", "--prefix", "p", "--format", "csv", "--jdbc-table", "t", "--jdbc-url", "jdbc:x:"]
    target = target_of(parser().parse_args([*base, "--jdbc-property", "ssl=true", "--jdbc-properties", f"{place}/p"]))
    assert target.properties == {"ssl": "true", "user": "ann", "password": "a=b#c"}
    for shown in ("password=x", "Password=x"):
        with pytest.raises(SystemExit, match="file"):
            target_of(parser().parse_args([*base, "--jdbc-property", shown]))
    with pytest.raises(SystemExit, match="file"):
        settings_of(["fs.s3a.secret.key=x"], None)


def test_catalog_and_recovery(spark, place, capsys):
    name = f"t_{uuid.uuid4().hex}"
    write_rows(spark, spark.range(40), f"{place}/t", 5)
    spark.sql(f"CREATE TABLE {name} (id bigint) USING parquet LOCATION '{place}/t'")
    run(spark, ["--no-hive", "compact-table", "--table", name, "--out", f"{place}/new"])
    assert "'files_before': 5, 'files_after': 1" in capsys.readouterr().out
    write_rows(spark, spark.range(40), f"{place}/again", 2)
    run(spark, ["promote-table", "--table", name, "--path", f"{place}/again", "--verify", "rows"])
    assert f"{place}/new" in capsys.readouterr().out
    assert len(spark.table(name).inputFiles()) == 2 and spark.table(name).count() == 40
    run(spark, ["recover", "-p", f"{place}/t"])
    assert "{'changed': []}" in capsys.readouterr().out
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("argv, hive", [(["compact", "-p", "/x/db"], True), (["--no-hive", "compact", "-p", "/x/db"], False)])
def test_the_command_line_works_on_the_hive_catalog(monkeypatch, argv, hive):
    seen = []
    monkeypatch.setattr(cli.SparkSession.Builder, "getOrCreate", lambda self: dict(self._options))
    monkeypatch.setattr(cli, "run", lambda options: seen.append(options))
    monkeypatch.setattr("sys.argv", ["packwright", *argv])
    cli.main()
    assert (seen[0].get("spark.sql.catalogImplementation") == "hive") == hive
