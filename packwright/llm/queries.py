"""The registered queries of this package and the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packwright.llm import (
    collocations, fp_tree, mixing, near_dedup, neighbours, packing, pii, quality_rules, substring_dedup, suffix_tree, token_counts, token_files, url_filter,
)
from packwright.llm.common import given, text_or_empty
from packwright.session import scratch_dir

#: Rules of the URL query.
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: The URL query lists the pages of hosts that have one of these words between dots and hyphens.
LISTED = "(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)"


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(given(spark, sf_dir, "documents"))


def private(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_private(given(spark, sf_dir, "documents"), id_column="doc_id", redact=False)
    return out.select("row.doc_id", *[c for c in out.columns if c != "row"])


def nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = given(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"), 20)


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(given(spark, sf_dir, "documents"), keep_row=False)
    return out.select(
        "row.doc_id", "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept"
    )


def three_edits(text: Column) -> Column:
    """A replacement at a third of the text, an insertion at its middle, and the loss of its last characters."""
    n = F.length(text)
    third, half = (n / 3).cast("int"), (n / 2).cast("int")
    edit = lambda start, end, new: F.struct(start.alias("start"), end.alias("end"), F.lit(new).alias("text"))
    return F.array(edit(third, third + 12, "revised wording"), edit(half, half, " (see note) "), edit(n, n + 9, ""), edit(n - 7, n + 20, ""))


def edited_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = given(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.build_and_edit(docs, three_edits(text_or_empty()), id_column="doc_id", keep_text=False)
    return out.select("row.doc_id", "tokens_before", F.col("n_tokens").alias("tokens_after"), "edited_chars", "encoded_again")


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(given(spark, sf_dir, "documents"), given(spark, sf_dir, "labels"), keep_row=False)
    return out.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule_text", "kept"
    )


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = given(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host(F.col("url")).rlike(LISTED))
    entries = url_filter.rule_entries(spark, URL_RULES).union(url_filter.listed_entries(listed))
    return url_filter.judge_urls(pages, entries).select("row.page_id", "host", "path", "rule", "verdict")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score(given(spark, sf_dir, "documents"))


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_ids(given(spark, sf_dir, "documents"), shingle_words=4, threshold=0.8)


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.without_repeats(given(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return out.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp_tree.rank_documents(given(spark, sf_dir, "benchmark"), given(spark, sf_dir, "documents"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(given(spark, sf_dir, "documents"))


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    token_files.write_token_files(given(spark, sf_dir, "documents"), path)
    out = token_files.read_documents(spark, path).select("doc_id", "start", "n_tokens", "ids")
    return token_files.with_crc32(out)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_two_fit": pack,
    "op2_private_spans": private,
    "op3_multiprobe_neighbours": nearest,
    "op4_raked_mix": mixed,
    "op5_edited_counts": edited_counts,
    "op6_decision_list": quality,
    "op7_url_bloom": urls,
    "op8_suffix_tree_scores": scores,
    "op9_near_duplicates": near,
    "op10_repeated_passages": repeats,
    "op11_fp_tree_search": ranked,
    "op12_collocations": phrases,
    "op13_token_files": token_rows,
}


def _urls_sql() -> str:
    rules = ", ".join(f"('{v}', '{r}')" for v, r in URL_RULES)
    return f"""
        WITH places AS (SELECT page_id,
                translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
            named AS (SELECT *, regexp_replace(regexp_replace(host, '^www\\.', ''), '\\.$', '')
                || regexp_replace(path, '/+$', '') AS canonical FROM places),
            listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '{LISTED}')),
            rules AS (SELECT verdict, rule, split_part(rule, '/', 1) AS h, substr(rule, instr(rule, '/')) AS p
                FROM (VALUES {rules}) AS t(verdict, rule)),
            fits AS (SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule,
                    arg_max(verdict, length(rule)) AS verdict
                FROM named JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
        SELECT n.page_id, n.host, n.path, f.rule, coalesce(f.verdict,
            CASE WHEN n.host <> '' AND n.canonical IN (SELECT canonical FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
        FROM named n LEFT JOIN (SELECT DISTINCT page_id, host, path, rule, verdict FROM fits) f
            ON n.page_id IS NOT DISTINCT FROM f.page_id AND n.host = f.host AND n.path = f.path"""


ORACLE_SQL: dict[str, str] = {
    "op4_raked_mix": mixing.mix_sql(),
    "op7_url_bloom": _urls_sql(),
    "op11_fp_tree_search": fp_tree.rank_sql(),
    "op12_collocations": collocations.collocations_sql(),
}
