"""URL rules and listed URLs by a blocked Bloom filter before an exact join.

Method. Every entry (a rule's host and path, or a listed canonical URL) sets one bit in each of the eight
64-bit lanes of one block. A URL's candidates (each parent domain with each rule path length, and its own
canonical form) are looked up in their block; those with all eight bits set go on to an exact join with the
entries, which removes the false positives. So results are exact whatever the filter's rate of false hits.

Scale. The filter has at most MAX_BLOCKS rows, so it can be sent to every executor; with more entries it lets
more candidates through and stays right. Entries are sent along only while a count shows that they are few,
else they are shuffled. Equal URLs are judged once. No page text is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm.common import let, written

LANES = 8
#: 16 bits of filter for an entry until this many blocks of 512 bits (5 MB as rows).
MAX_BLOCKS = 1 << 16
#: Entries that may be sent to every executor (checked by count; about 30 MB).
FEW_ENTRIES = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    """After the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or url."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host_: Column, path_: Column) -> Column:
    """Host without a leading `www.` or a closing dot, path without closing slashes."""
    return F.concat(
        F.regexp_replace(F.regexp_replace(host_, r"^www\.", ""), r"\.$", ""), F.regexp_replace(path_, r"/+$", "")
    )


def rule_entries(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Entries (key, rule, verdict) for (verdict, host/path)."""
    rows = [("r " + r, r, v) for v, r in rules]
    return spark.createDataFrame(rows, "key string, rule string, verdict string")


def listed_entries(urls: DataFrame, column: str = "url") -> DataFrame:
    """Entries that block listed URLs, by their canonical form; null and host-less ones list nothing."""
    h, p = host(F.col(column)), path(F.col(column))
    return urls.where(h != "").select(
        F.concat(F.lit("u "), canonical(h, p)).alias("key"), F.lit(None).cast("string").alias("rule"),
        F.lit("block").alias("verdict"),
    ).distinct()


def _bits(key: Column) -> list[Column]:
    g = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(LANES)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def blocked_bloom(entries: DataFrame, n_entries: int) -> tuple[DataFrame, int]:
    """(block, w0 .. w7), one row per block with an entry, and the number of blocks."""
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * 512 < n_entries * 16:
        blocks *= 2
    lanes = [F.expr(f"shiftleft(1L, b{i})").alias(f"w{i}") for i in range(LANES)]
    set_bits = entries.select(
        _block(F.col("key"), blocks).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(_bits(F.col("key")))]
    ).select("block", *lanes)
    return set_bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(LANES)]), blocks


def possible(rows: DataFrame, key: str, entries: DataFrame) -> DataFrame:
    """The rows, with `possible`: true for every key that the entries (one column, distinct) hold, and for few
    others. The filter goes to the rows, so nothing of them is shuffled; a null key is not possible."""
    entries = entries.toDF("key")
    bloom, blocks = blocked_bloom(entries, entries.count())
    bits = dict(zip([f"_b{i}" for i in range(LANES)], _bits(F.col(key)), strict=True))
    bloom = bloom.select(F.col("block").alias("_block"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(LANES)])
    met = rows.withColumns({"_block": _block(F.col(key), blocks), **bits}).join(F.broadcast(bloom), "_block", "left")
    set_ = " and ".join(f"(shiftrightunsigned(_w{i}, _b{i}) & 1) = 1" for i in range(LANES))
    flag = F.col(key).isNotNull() & F.coalesce(F.expr(set_), F.lit(False))
    return met.select(*rows.columns, flag.alias("possible"))


def judge_urls(pages: DataFrame, entries: DataFrame, url_column: str = "url") -> DataFrame:
    """All columns of the pages as struct `row`, with host, path, rule, verdict and listed.

    The longest fitting rule decides; without one, a listed URL is blocked and any other allowed. Defined
    cases: a null url, or one without `://`, has an empty host and path, fits no rule and is allowed; of rules
    with equal text and contrary verdicts, block wins; repeated rows get the same answer; no entries: all
    is allowed; an empty table gives no row.
    """
    entries = written(entries.groupBy("key").agg(F.max("rule").alias("rule"), F.max("verdict").alias("verdict")), "entries")
    n_entries = entries.count()
    slash = F.instr(F.col("rule"), "/")
    lengths = [
        r.n for r in entries.where("rule is not null").select(
            F.when(slash == 0, 0).otherwise(F.length("rule") - slash + 1).alias("n")
        ).distinct().collect()
    ]
    packed = pages.select(
        F.struct("*").alias("row"), host(F.col(url_column)).alias("host"), path(F.col(url_column)).alias("path")
    )
    places = packed.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    parents = let(labels, lambda a: F.transform(
        F.sequence(F.lit(1), F.size(a)), lambda i: F.array_join(F.slice(a, i, F.size(a)), ".")
    ))
    heads = F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in sorted(lengths)]).cast("array<string>")
    by_rule = F.flatten(F.transform(parents, lambda d: F.transform(
        F.filter(heads, lambda h: h.isNotNull()), lambda h: F.concat(F.lit("r "), d, h)
    )))
    asked = places.where("host <> ''").select(
        "host", "path",
        F.explode(F.array_append(by_rule, F.concat(F.lit("u "), canonical(F.col("host"), F.col("path"))))).alias("key"),
    )
    bloom, blocks = blocked_bloom(entries, n_entries)
    hashed = asked.withColumn("block", _block(F.col("key"), blocks)).withColumns(
        {f"b{i}": b for i, b in enumerate(_bits(F.col("key")))}
    )
    set_ = " and ".join(f"(shiftrightunsigned(w{i}, b{i}) & 1) = 1" for i in range(LANES))
    possible = hashed.join(F.broadcast(bloom), "block").where(set_).select("host", "path", "key")
    sure = possible.join(F.broadcast(entries) if n_entries <= FEW_ENTRIES else entries.hint("shuffle_hash"), "key")
    best = sure.groupBy("host", "path").agg(
        F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule"), "rule", "verdict"))).alias("best"),
        F.bool_or(F.col("rule").isNull()).alias("listed"),
    )
    listed = F.coalesce("listed", F.lit(False))
    return packed.join(best, ["host", "path"], "left").select(
        "row", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(listed, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        listed.alias("listed"),
    )
