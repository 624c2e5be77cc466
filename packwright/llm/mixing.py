"""Mixing sources to target weights: raked token weights, then sampling by calibrated probabilities.

Method. Iterative proportional fitting: tokens are summed by cell (source, language, topic). A sweep scales
the cells of each source to the source's target, then those of each language, then those of each topic, and
cuts every cell at the tokens it has. After the last sweep a document of the cell is kept with probability
weight / tokens, so the expected tokens follow the targets as far as the corpus can fill them. A document's
draw is a hash of its id: the same whatever the order or the number of executors.

Scale. One narrow pass sums tokens by cell, map-side first; sweeps work on the cells, of which there are at
most sources * languages * topics, as Spark aggregations. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.llm.common import text_or_empty, word_array, written

#: Sweeps over all marginals; share of all tokens wanted; how flat a target is (1: as it is, 0: all equal).
SWEEPS, BUDGET, FLATNESS = 8, 0.5, {"source": 0.5, "lang": 0.7, "topic": 0.7}
#: Cells that may be sent to every executor (checked by count).
FEW_CELLS = 100_000
SEED = "mix"


def topic_of(text: Column) -> Column:
    """Kind of text, by marks of its layout and wording."""
    return (
        F.when(F.instr(text, " | ") > 0, "table")
        .when(F.instr(text, "icens") > 0, "legal")
        .when(F.instr(text, "@") > 0, "contact")
        .otherwise("prose")
    )


def draw(id_: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id; documents without one draw by their text."""
    key = F.concat(F.coalesce(id_.cast("string"), F.md5(text)), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def flattened(cells: DataFrame, marginal: str, power: float) -> DataFrame:
    """Targets (value, share) in proportion to tokens ** power."""
    return cells.groupBy(F.col(marginal).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), power).alias("share"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET, sweeps: int = SWEEPS) -> DataFrame:
    """Cells with `weight` after the sweeps and `probability` = weight / tokens.

    `targets` has for each marginal, a column of the cells, a frame (value, share); the shares of a marginal
    are brought to sum one. A value without a target gets no weight. Null is a value like others.
    """
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    start = [F.col(c) for c in cells.columns]
    at = cells
    for name, target in targets.items():
        whole = target.agg(F.sum("share")).first()[0] or 1.0
        wanted = target.select(
            F.col("value").alias("_value"), (F.col("share") / whole * budget * total).alias(f"_want_{name}")
        )
        at = at.join(wanted, F.col(name).eqNullSafe(F.col("_value")), "left").drop("_value").fillna(0.0, [f"_want_{name}"])
    at = at.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        for name in targets:
            now = F.sum("weight").over(Window.partitionBy(name))
            at = at.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"_want_{name}") / now).otherwise(0.0))
        at = written(at.withColumn("weight", F.least("weight", F.col("tokens").cast("double"))), "weights")
    share = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    return at.select(*start, "weight", share.alias("probability"))


def mix(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    budget: float = BUDGET,
    id_column: str = "doc_id",
    text_column: str = "text",
    source: str = "source",
    language: str = "lang",
    topic: Column | None = None,
    seed: str = SEED,
    sweeps: int = SWEEPS,
    keep_row: bool = True,
) -> DataFrame:
    """All columns of the documents as struct `row` (or the id alone), with source, lang, topic, n_tokens
    (words), probability and kept.

    Defined cases: a null or empty text has no token and is never kept (it adds nothing to any weight); null
    source or language is a value like others; repeated rows share their draw, a document without id draws by
    its text; extra columns of any name travel inside `row`; an empty table gives no row.
    """
    text = text_or_empty(text_column)
    row = F.struct("*") if keep_row else F.struct(F.col(id_column))
    sized = docs.select(
        row.alias("row"), F.col(source).alias("source"), F.col(language).alias("lang"),
        (topic_of(text) if topic is None else topic).alias("topic"),
        F.size(word_array(text)).cast("long").alias("n_tokens"),
        draw(F.col(id_column), text, seed).alias("draw"),
    )
    if not keep_row:
        sized = written(sized, "sized")
    names = ["source", "lang", "topic"]
    cells = written(sized.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "cells")
    targets = targets or {n: flattened(cells, n, FLATNESS[n]) for n in names}
    chances = raked(cells, targets, budget, sweeps).select(*[F.col(n).alias(f"_{n}") for n in names], "probability")
    few = chances.count() <= FEW_CELLS
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_{n}"))
    out = sized.join(F.broadcast(chances) if few else chances, same, "left")
    return out.select("row", *names, "n_tokens", "probability", ((F.col("draw") < F.col("probability")) & (F.col("n_tokens") > 0)).alias("kept"))


def mix_sql(budget: float = BUDGET, sweeps: int = SWEEPS, seed: str = SEED) -> str:
    """The same in DuckDB's SQL, for `documents` with default targets."""
    names = ["source", "lang", "topic"]
    steps = [
        f"""sized AS (SELECT doc_id, source, lang,
            CASE WHEN instr(t, ' | ') > 0 THEN 'table' WHEN instr(t, 'icens') > 0 THEN 'legal'
                 WHEN instr(t, '@') > 0 THEN 'contact' ELSE 'prose' END AS topic,
            len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS n_tokens,
            ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(t)) || ':{seed}'), 1, 13))::BIGINT / {float(1 << 52)} AS draw
            FROM (SELECT *, coalesce(text, '') AS t FROM documents))""",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM sized GROUP BY ALL)",
    ]
    for n in names:
        steps.append(f"""want_{n} AS (SELECT {n}, s / sum(s) OVER () * {budget} * (SELECT sum(tokens) FROM cells) AS w
            FROM (SELECT {n}, pow(sum(tokens), {FLATNESS[n]}) AS s FROM cells GROUP BY {n}))""")
    steps.append("""w0 AS (SELECT c.*, a.w AS want_source, b.w AS want_lang, d.w AS want_topic, tokens AS weight
        FROM cells c JOIN want_source a ON c.source IS NOT DISTINCT FROM a.source
        JOIN want_lang b ON c.lang IS NOT DISTINCT FROM b.lang
        JOIN want_topic d ON c.topic IS NOT DISTINCT FROM d.topic)""")
    last = "w0"
    for i in range(sweeps):
        for n in names:
            to = f"w{i}_{n}"
            steps.append(f"""{to} AS (SELECT * REPLACE (CASE WHEN now > 0 THEN weight * want_{n} / now ELSE 0 END AS weight)
                FROM (SELECT *, sum(weight) OVER (PARTITION BY {n}) AS now FROM
                (SELECT source, lang, topic, tokens, want_source, want_lang, want_topic, weight FROM {last})))""")
            last = to
        steps.append(f"w{i}_cut AS (SELECT * REPLACE (least(weight, tokens) AS weight) FROM {last})")
        last = f"w{i}_cut"
    return f"""WITH {', '.join(steps)}
        SELECT doc_id, s.source, s.lang, s.topic, n_tokens,
            round(CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END, 6) AS probability,
            n_tokens > 0 AND draw < CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS kept
        FROM sized s JOIN {last} c ON s.source IS NOT DISTINCT FROM c.source
            AND s.lang IS NOT DISTINCT FROM c.lang AND s.topic IS NOT DISTINCT FROM c.topic"""
