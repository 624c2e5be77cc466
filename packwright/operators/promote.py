"""Put a finished copy in the place of the live data: by renames, or in the catalog.

A swap by rename sets the old tree aside, puts the new one in its place, and only then is the old one deleted.
Renames are metadata calls: there is nothing to distribute, but many may be under way at a time. What is going to
be renamed is written down first, beside the live directory; from that journal `recover` takes a swap back, or to
its end, wherever it was cut off.

A swap in the catalog renames nothing: the table is pointed at the new directory. On object stores, where a rename
is a copy, it is the only safe one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.errors import BrokenSwapError, InventoryError, LateFileError, PromotionError, VerificationError
from packwright.functions.columns import below
from packwright.operators.verify import verify_compaction
from packwright.session import JOB_SETTINGS, LISTING_SETTINGS, freeze, scratch_dir, settings
from packwright.sources.files import list_files
from packwright.sources.formats import checked_identifier
from packwright.storage import Storage, in_threads, normalise

# Names beside a live directory `<base>`: the finished copy, the old tree while a swap is under way, its journal.
STAGING_SUFFIX = "_bkup"
RETIRED_SUFFIX = "_old"
JOURNAL_SUFFIX = "_swap"

# Inside a copy: the files it was made of, for the swap to hold the live ones against.
SOURCES = ".packwright-sources"


def map_path(path: str, base: str, target: str) -> str:
    """The place below `target` of a path below `base`; only the leading text is replaced."""
    base, target = normalise(base), normalise(target)
    if path != base and not path.startswith(base + "/"):
        raise PromotionError(f"{path} is not below {base}")
    if target == base or target.startswith(base + "/"):
        raise PromotionError(f"{target} lies inside {base}, which the swap would remove")
    return target + path[len(base) :]


def staging_path(base: str) -> str:
    return normalise(base) + STAGING_SUFFIX


def journal_path(live: str) -> str:
    return normalise(live) + JOURNAL_SUFFIX


def swap(storage: Storage, live: str, triples: Sequence[tuple[str, str, str]]) -> None:
    """For each (live, staged, retired): live becomes retired, staged becomes live. All or none.

    The journal of `live` stays until `finish_swap` or `undo_swap`.
    """
    storage.write_new(journal_path(live), json.dumps({"renames": [list(t) for t in triples]}))
    try:
        in_threads(lambda t: _forward(storage, *t), triples)
    except Exception as failure:
        undo_swap(storage, live, triples)
        raise PromotionError("the swap failed and was undone") from failure


def undo_swap(storage: Storage, live: str, triples: Sequence[tuple[str, str, str]]) -> None:
    """Put the old trees back, whatever has been renamed so far, and drop the journal."""
    try:
        in_threads(lambda t: _backward(storage, *t), triples)
    except Exception as second:
        raise BrokenSwapError(f"left as it is; {journal_path(live)} says what was to be renamed") from second
    storage.delete(journal_path(live))


def finish_swap(storage: Storage, live: str) -> None:
    """From here on the new trees are the live ones."""
    storage.delete(journal_path(live))


def _forward(storage: Storage, live: str, staged: str, retired: str) -> bool:
    """Take one triple to its end from any state between; whether there was anything to do."""
    if not storage.exists(staged):
        return False
    if storage.exists(live):
        storage.rename(live, retired)
    storage.rename(staged, live)
    return True


def _backward(storage: Storage, live: str, staged: str, retired: str) -> bool:
    if not storage.exists(retired):
        return False
    if storage.exists(live):
        storage.rename(live, staged)
    storage.rename(retired, live)
    return True


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """The files below a directory: path relative to it, bytes, modified."""
    place = Storage(spark, root).qualified(normalise(root))
    return list_files(spark, root).select(_relative(F.col("path"), place), "bytes", "modified")


def _relative(path: Column, root: str) -> Column:
    return below(path, root).alias("path")


def keep_sources(files: DataFrame, root: str, copy: str) -> None:
    """Leave the list of files that a copy was made of inside the copy; readers do not see it."""
    listed = files.select(_relative(F.col("path"), Storage(files.sparkSession, root).qualified(root)), "bytes", "modified")
    listed.write.mode("errorifexists").parquet(f"{copy}/{SOURCES}")


def _known_sources(spark: SparkSession, live: str, staged: str) -> DataFrame:
    """The files the copy was made of, taken out of it; without such a list, those that are there now."""
    storage, place = Storage(spark, staged), f"{scratch_dir(spark, 'swap')}/sources"
    with settings(spark, {**JOB_SETTINGS, **LISTING_SETTINGS}):
        if not storage.exists(f"{staged}/{SOURCES}"):
            return freeze(source_files(spark, live), place)
        known = freeze(spark.read.parquet(f"{staged}/{SOURCES}"), place)
        changed = _differing(known, source_files(spark, live))
    if changed:
        raise InventoryError(f"files came, went or changed after the copy was made: {changed}")
    return known


def _differing(one: DataFrame, other: DataFrame) -> list[str]:
    columns = ["path", "bytes", "modified"]
    both = one.select(*columns, F.lit(1).alias("side")).unionAll(other.select(*columns, F.lit(-1).alias("side")))
    both = both.groupBy(*columns).agg(F.sum("side").alias("side")).where("side <> 0")
    return sorted({r.path for r in both.limit(5).collect()})


def promote(
    spark: SparkSession,
    base: str,
    staging: str | None = None,
    refresh: Sequence[str] = (),
    keep_old: bool = False,
    late_files: bool = True,
) -> None:
    """Put `staging` in the place of `base`. `refresh` names catalog tables whose files changed.

    Check the copy first (`verify_compaction`). If a file came, went or changed in `base` since the copy was made,
    nothing is swapped; if one came during the swap, the swap is undone (`LateFileError`). A copy that was not made
    by a compaction has no list of its sources: then files count from the call on. `late_files=False` leaves both
    out, for a copy that is not made of the old files. The old directory's access rights go to the new one. A
    reader that lists the directory between the two renames sees no directory; where a rename copies, use
    `promote_table`.
    """
    live = normalise(base)
    staged = normalise(staging or staging_path(base))
    map_path(live, live, staged)
    storage = Storage(spark, live)
    for path in (live, staged):
        if not storage.exists(path):
            raise PromotionError(f"{path} does not exist")
    retired = live + RETIRED_SUFFIX
    for path in (retired, journal_path(live)):
        if storage.exists(path):
            raise PromotionError(f"{path} is left from an earlier swap; see recover()")
    known = _known_sources(spark, live, staged) if late_files else None
    storage.delete(f"{staged}/{SOURCES}")
    storage.copy_rights(live, staged)
    triples = [(live, staged, retired)]
    swap(storage, live, triples)
    if known is not None:
        with settings(spark, LISTING_SETTINGS):
            late = _differing(known, source_files(spark, retired))
        if late:
            undo_swap(storage, live, triples)
            raise LateFileError(f"files came during the swap, which was undone: {late}")
    finish_swap(storage, live)
    if not keep_old:
        storage.delete(retired)
    refresh_readers(spark, live, refresh)


def promote_table(spark: SparkSession, table: str, path: str, verify: str = "full") -> str:
    """Point a catalog table at the checked copy in `path`; returns its old directory, which is left as it is.

    No file is renamed: a reader sees the old files or the new ones. The copy is compared with the table's own
    directory, partition by partition (`verify`), and must be made of its present files. Partitions the catalog
    keeps follow the table, one by one; if any of them, or the check for files that came meanwhile, fails, all are
    pointed back. Views, tables of another format than Parquet, and partitions outside the table's directory are
    refused.
    """
    name, new = checked_identifier(table), normalise(path)
    facts = _described(spark, name)
    old = table_location(spark, name)
    storage = Storage(spark, old)
    old, new = storage.qualified(old), Storage(spark, new).qualified(new)
    map_path(old, old, new)
    map_path(new, new, old)
    parts = _partitions(spark, name, facts, storage, old)
    known = _known_sources(spark, old, new)
    report = verify_compaction(spark, old, new, verify)
    wrong = report.where(~F.col("equal")).limit(5).collect()
    if wrong:
        raise VerificationError(f"partitions of {new} differ from those of {table}, for instance {wrong}")
    target = Storage(spark, new)
    moved: list[tuple[str, str]] = []

    def point(spec: str, place: str, back: str) -> None:
        moved.append((spec, back))
        spark.sql(f"ALTER TABLE {name} {spec} SET LOCATION '{_quoted(place)}'")

    try:
        for spec, relative in parts:
            target.mkdirs(f"{new}/{relative}")
            point(spec, f"{new}/{relative}", f"{old}/{relative}")
        point("", new, old)
        spark.sql(f"REFRESH TABLE {name}")
        with settings(spark, LISTING_SETTINGS):
            late = _differing(known, source_files(spark, old))
        if late:
            raise LateFileError(f"files came during the swap, which was undone: {late}")
    except Exception:
        for spec, back in reversed(moved):
            spark.sql(f"ALTER TABLE {name} {spec} SET LOCATION '{_quoted(back)}'")
        spark.sql(f"REFRESH TABLE {name}")
        raise
    target.delete(f"{new}/{SOURCES}")
    return old


def table_location(spark: SparkSession, table: str) -> str:
    """The directory of a catalog table of Parquet files."""
    facts = _described(spark, checked_identifier(table))
    kind = str(facts.get("provider", "")).lower()
    if facts.get("type") == "VIEW" or "location" not in facts or kind not in ("parquet", "hive"):
        raise PromotionError(f"{table} is not a table of Parquet files")
    return normalise(facts["location"])


def _described(spark: SparkSession, table: str, partition: str = "") -> dict:
    return json.loads(spark.sql(f"DESCRIBE TABLE EXTENDED {table} {partition} AS JSON").first()[0])


def _partitions(spark: SparkSession, table: str, facts: dict, storage: Storage, root: str) -> list[tuple[str, str]]:
    """The partitions the catalog keeps, as (PARTITION clause, directory below the table's)."""
    if not facts.get("partition_columns") or facts.get("partition_provider", "Catalog") != "Catalog":
        return []
    out = []
    for row in spark.sql(f"SHOW PARTITIONS {table}").collect():
        values = [part.split("=", 1) for part in row[0].split("/")]
        spec = "PARTITION (" + ", ".join(f"`{k}` = {_value(v)}" for k, v in values) + ")"
        at = storage.qualified(normalise(_described(spark, table, spec)["location"]))
        if not at.startswith(root + "/"):
            raise PromotionError(f"{spec} of {table} lies outside its directory: {at}")
        out.append((spec, at[len(root) + 1 :]))
    return out


def _value(text: str) -> str:
    from urllib.parse import unquote

    return "NULL" if text in ("__HIVE_DEFAULT_PARTITION__", "null") else f"'{_quoted(unquote(text))}'"


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def recover(spark: SparkSession, base: str, forward: bool = False) -> list[str]:
    """Take a swap that was cut off back to the old tree, or with `forward` on to the new one.

    Returns the live paths that changed. What the swap was to rename is read from its journal, which goes at the
    end. Then the copy is at `<base>_bkup` again; or, forward, the old tree is left at `<base>_old` for the caller
    to look at and remove, since files may have come into it. Without a journal, whatever is live stays, and what
    is missing there is put back from `<base>_old`.
    """
    live = normalise(base)
    storage = Storage(spark, live)
    journal, retired = journal_path(live), live + RETIRED_SUFFIX
    if storage.exists(journal):
        triples = [tuple(t) for t in json.loads(storage.read_text(journal))["renames"]]
        step = _forward if forward else _backward
        changed = in_threads(lambda t: step(storage, *t), triples)
        storage.delete(journal)
        if not forward and storage.exists(retired) and source_files(spark, retired).isEmpty():
            storage.delete(retired)
        return [t[0] for t, done in zip(triples, changed, strict=True) if done]
    restored: list[str] = []

    def restore(path: str, old: str) -> None:
        if not storage.exists(path):
            storage.rename(old, path)
            restored.append(path)
            return
        for name in storage.child_dirs(old):
            restore(f"{path}/{name}", f"{old}/{name}")

    if storage.exists(retired):
        restore(live, retired)
    return restored


def refresh_readers(spark: SparkSession, path: str, tables: Sequence[str]) -> None:
    """Drop file listings this session has cached for a path or a catalog table."""
    spark.catalog.refreshByPath(path)
    for table in tables:
        spark.catalog.refreshTable(table)
