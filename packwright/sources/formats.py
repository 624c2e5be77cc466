"""Decode the files under a key prefix strictly against the target's schema."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright.errors import MaintenanceError
from packwright.functions.columns import named
from packwright.sources.records import joined_lines, single_lines, text_lines
from packwright.storage import Storage, in_threads, literal

# Formats a load may name, and the options each is read with unless the caller says otherwise. In CSV a
# quote inside a quoted field is doubled, and there is no header line; `delimited` is CSV's plain form
# with a pipe and without quotes; `fixed` has columns of the option's `widths`. Avro needs the external
# spark-avro package.
FORMATS = {
    "csv": ("csv", {"sep": ",", "quote": '"', "escape": '"'}),
    "delimited": ("csv", {"sep": "|", "quote": "", "escape": ""}),
    "fixed": ("text", {}),
    "json": ("json", {}),
    "parquet": ("parquet", {"mergeSchema": "true"}),
    "orc": ("orc", {"mergeSchema": "true"}),
    "avro": ("avro", {}),
}

# What the field parser calls an unquoted blank, so that it differs from a quoted empty text: no valid text.
_BLANK = "\uffff blank \uffff"

# Options that would leave files out of a load.
_SKIPPING = {"ignorecorruptfiles", "ignoremissingfiles", "pathglobfilter", "modifiedbefore", "modifiedafter"}

# Options of delimited text that say how lines become records, and those that go to the scan of lines.
_RECORDS = {"header", "multi_line", "multiline", "lineSep", "linesep", "mode"}
_SCAN = ("encoding", "charset")

# Timestamps without zone in JSON keep their microseconds; CSV's own reader takes a `T` and a blank.
_MICROS = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"}


def read_prefix(
    spark: SparkSession,
    root: str,
    prefix: str,
    file_format: str,
    schema: T.StructType,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Every file whose key starts with `prefix`, at any depth, as rows of `schema`.

    Text is decoded with the schema, and a record that does not fit it stops the load. In delimited text a blank
    field is NULL and a quoted empty one the empty text; a value may hold line breaks with the option `multi_line`,
    and stops the load without it; `header` skips each file's first record. Parquet, ORC and Avro columns are taken
    by position, file by file, and must be storable in the target's types; JSON goes by name. `options` go to the
    reader and may carry access settings (`fs.s3a.*`); those that skip files are refused.
    """
    if file_format not in FORMATS:
        raise MaintenanceError(f"format must be one of {sorted(FORMATS)}: {file_format!r}")
    given = dict(options or {})
    refused = sorted(o for o in given if o.lower() in _SKIPPING)
    if refused:
        raise MaintenanceError(f"a load reads every file under its prefix; not allowed: {refused}")
    source, defaults = FORMATS[file_format]
    open_schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    pattern = f"{literal(root.rstrip('/'))}/{literal(prefix)}*"
    if source == "csv":
        rows = _delimited(spark, pattern, open_schema, {**defaults, **given})
    elif source == "text":
        rows = _fixed(spark, pattern, open_schema, given)
    elif source == "json":
        reader = spark.read.format(source).options(**_MICROS).schema(open_schema).options(**given)
        rows = reader.option("mode", "FAILFAST").option("recursiveFileLookup", "true").load(pattern)
    else:
        rows = _by_position(spark, source, pattern, open_schema, {**defaults, **given, "recursiveFileLookup": "true"})
    return rows.select(*[_required(f) for f in schema.fields])


def _delimited(spark: SparkSession, pattern: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """Records of text first, then each record's fields in the target's types."""
    flags = {k.lower().replace("_", ""): str(v).lower() == "true" for k, v in options.items() if k in _RECORDS}
    scan = {k: v for k, v in options.items() if k.lower() in _SCAN or k.startswith("fs.")}
    lines = text_lines(spark, pattern, scan)
    multi_line, header = flags.get("multiline", False), flags.get("header", False)
    quote, escape = options["quote"], options["escape"]
    if multi_line or header:
        records = joined_lines(lines, quote, escape, multi_line, header)
    else:
        records = single_lines(lines, quote, escape)
    fields = {k: v for k, v in options.items() if k not in _RECORDS and k not in scan}
    fields = {"nullValue": _BLANK, "emptyValue": "", **fields, "mode": "FAILFAST"}
    row = F.from_csv("value", _ddl(schema), fields)
    return records.where(F.trim("value") != "").select(row.alias("row")).select("row.*")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def _fixed(spark: SparkSession, pattern: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """Columns of fixed widths, in letters. Blanks at a value's end are padding; a value of blanks only is NULL."""
    widths = [int(w) for w in str(options.get("widths", "")).split(",") if w.strip()]
    if len(widths) != len(schema.fields) or min(widths, default=0) < 1:
        raise MaintenanceError(f"`widths` must give {len(schema.fields)} positive numbers: {options.get('widths')!r}")
    scan = {k: v for k, v in options.items() if k.lower() in _SCAN or k.startswith("fs.")}
    line = F.regexp_replace("value", "\r$", "")
    message = F.concat(F.lit(f"a line must have {sum(widths)} letters: "), F.substring(line, 1, 80))
    lines = text_lines(spark, pattern, scan).where(line != "").select(
        F.when(F.length(line) == sum(widths), line).otherwise(F.raise_error(message)).alias("line")
    )
    at, values = 1, []
    for f, width in zip(schema.fields, widths, strict=True):
        value = F.rtrim(F.substring("line", at, width))
        values.append(F.when(value != "", value).cast(f.dataType).alias(f.name))
        at += width
    return lines.select(*values)


def _by_position(spark: SparkSession, source: str, pattern: str, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """Columnar files, each by the order of its own columns: one scan for the files of each order."""
    listed = spark.read.options(**options).format("binaryFile").load(pattern).select("path").collect()
    orders: dict[tuple[str, ...], list[str]] = {}
    columns = in_threads(lambda r: _file_columns(spark, source, r.path, options), listed)
    for r, names in zip(listed, columns, strict=True):
        orders.setdefault(names, []).append(r.path)
    if len({len(names) for names in orders} - {len(schema.fields)}) > 0 or not orders:
        found = sorted({len(names) for names in orders})
        raise MaintenanceError(f"the files have {found} columns, the target {len(schema.fields)}")
    rows = None
    for names, paths in orders.items():
        where = [pattern] if len(orders) == 1 else [literal(p) for p in paths]
        part = spark.read.format(source).options(**options).load(where)
        if len(part.columns) != len(names):
            raise MaintenanceError(f"files with columns {names} do not merge into that many")
        part = part.select(*[named(n) for n in names]).toDF(*schema.names).to(schema)
        rows = part if rows is None else rows.unionAll(part)
    return rows


def _file_columns(spark: SparkSession, source: str, path: str, options: dict[str, str]) -> tuple[str, ...]:
    """The column names of one file in its own order, from its footer: a metadata call."""
    place = Storage(spark, path)
    if source == "parquet":
        return place.parquet_columns(path)
    if source == "orc":
        return place.orc_columns(path)
    return tuple(spark.read.format(source).options(**options).load(literal(path)).columns)


def _required(field: T.StructField) -> Column:
    """The column; a NULL stops the load where the target does not allow one."""
    value = named(field.name)
    if field.nullable:
        return value
    message = F.lit(f"NULL in column {field.name}, which does not allow it")
    return F.when(value.isNull(), F.raise_error(message)).otherwise(value).alias(field.name)


def checked_identifier(name: str) -> str:
    """A table name of one to three plain parts; anything else is refused."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*){0,2}", name or ""):
        raise MaintenanceError(f"not a plain table name: {name!r}")
    return name
