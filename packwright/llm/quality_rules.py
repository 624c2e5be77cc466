"""Learned decision lists over text statistics, all in DataFrame functions.

Method. Statistics of whole texts are computed natively. On labelled documents, sequential covering grows a
rule as a conjunction of thresholds: each step adds the threshold with the highest FOIL gain on the growing
part; then conditions are dropped from the end while that does not lower (p - n) / (p + n) on the pruning
part. A rule that is precise enough on both parts joins the list, what it covers leaves the growing part, and
the next is grown. The list becomes one ordered CASE expression: first rule that fires rejects.

Scale. Each step is one aggregation over the labelled rows, by (statistic, bin) of at most BINS bins, which is
summed up before the shuffle; the driver sees only those sums. Documents themselves take one narrow pass.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packwright.llm.common import GAP, SPACES, WORD, let, text_or_empty, written

#: Documented bounds of the learner: quantile bins per statistic, conditions per rule, rules per list.
BINS, CONDITIONS, RULES = 32, 3, 8
#: A rule needs this share of low-quality documents among those it covers, on both parts, and this many.
PRECISION, SUPPORT = 0.95, 5
WINDOW = 5

FEATURES = (
    "n_words", "mean_chars", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "bar_share", "stop_share",
)


@dataclass(frozen=True)
class Rule:
    """statistic <= or > threshold, all of them."""

    conditions: tuple[tuple[str, str, float], ...]

    def column(self, of) -> Column:
        out = F.lit(True)
        for name, sign, threshold in self.conditions:
            out = out & ((of(name) <= threshold) if sign == "<=" else (of(name) > threshold))
        return out

    def __str__(self) -> str:
        return " AND ".join(f"{n} {s} {t:.6g}" for n, s, t in self.conditions)


def _repeat_words(words: Column) -> Column:
    """Words inside windows of five that the text holds at least twice, the first included."""

    def covered(windows: Column) -> Column:
        placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def from_sorted(s: Column) -> Column:
            n = F.size(s)
            twice = F.filter(
                s,
                lambda x, i: ((i > 0) & (x["h"] == F.get(s, i - 1)["h"])) | ((i < n - 1) & (x["h"] == F.get(s, i + 1)["h"])),
            )
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return let(starts, lambda p: F.aggregate(
                F.transform(p, lambda at, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - at, F.lit(WINDOW)))),
                F.lit(0).cast("long"), lambda a, x: a + x,
            ))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(placed), from_sorted)
        )

    def of_hashes(h: Column) -> Column:
        n = F.size(h)
        at = F.sequence(F.lit(0), n - WINDOW)
        windows = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(let(windows, covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def statistics(text: Column) -> Column:
    """Struct of counts of a text; a null or empty one has zeros."""

    def counted(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda line: line.rlike(WORD))
        trimmed = F.btrim(t, F.lit(SPACES))
        words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP, -1))
        without = lambda pattern: F.length(F.regexp_replace(t, pattern, "")).cast("long")

        def of_words(w: Column) -> Column:
            return F.struct(
                F.size(w).cast("long").alias("n_words"),
                without(GAP).alias("word_chars"),
                without(r"[^#*$%&|<>]+").alias("n_symbols"),
                let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
                _repeat_words(w).alias("n_repeat_words"),
                without(r"[^\p{Lu}]+").alias("n_upper"),
                without(r"[^0-9]+").alias("n_digits"),
                without(r"[^|]+").alias("n_bars"),
                F.size(F.filter(w, lambda x: F.length(x) <= 3)).cast("long").alias("n_short"),
            )

        return let(words, of_words)

    return let(text, counted)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def features(s: Column) -> Column:
    """The statistics a rule may test, as shares that do not grow with the text."""
    words = F.greatest(s["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(s["word_chars"], F.lit(1)).cast("double")
    return F.struct(
        s["n_words"].cast("double").alias("n_words"),
        (s["word_chars"] / words).alias("mean_chars"),
        (s["n_symbols"] / chars).alias("symbol_share"),
        (s["n_dup_lines"] / words).alias("dup_line_share"),
        (s["n_repeat_words"] / words).alias("repeat_share"),
        (s["n_upper"] / chars).alias("upper_share"),
        (s["n_digits"] / chars).alias("digit_share"),
        (s["n_bars"] / words).alias("bar_share"),
        (s["n_short"] / words).alias("stop_share"),
    )


def learn(labelled: DataFrame) -> list[Rule]:
    """A decision list for rows (f: struct of FEATURES, bad: boolean, prune: boolean).

    No rule is learned from an empty table or without documents of both kinds.
    """
    cuts_of = labelled.agg(
        *[F.percentile_approx(f"f.{n}", [i / BINS for i in range(1, BINS)], 10_000).alias(n) for n in FEATURES]
    ).first()
    cuts = {n: sorted(set(cuts_of[n] or [])) for n in FEATURES}
    # Bin k of a statistic holds values with exactly k cuts below them.
    def bin_of(name: str) -> Column:
        values = F.array(*[F.lit(float(c)) for c in cuts[name]]).cast("array<double>")
        return F.size(F.filter(values, lambda c: F.col(f"f.{name}") > c))

    binned = F.array(*[F.struct(F.lit(n).alias("name"), bin_of(n).alias("bin")) for n in FEATURES])
    rows = written(labelled.select("f", "bad", "prune", binned.alias("bins")), "labelled")
    of = lambda name: F.col(f"f.{name}")
    rules: list[Rule] = []
    while len(rules) < RULES:
        left = rows
        for rule in rules:
            left = left.where(~rule.column(of))
        rule = _grow(left.where(~F.col("prune")), cuts, of)
        if rule is None:
            break
        rule, seen = _pruned(rule, left, of)
        if min(p + n for p, n in seen) < SUPPORT or min(p / (p + n) for p, n in seen) < PRECISION:
            break
        rules.append(rule)
    return rules


def _grow(rows: DataFrame, cuts: dict[str, list[float]], of) -> Rule | None:
    conditions: list[tuple[str, str, float]] = []
    covered = rows
    while len(conditions) < CONDITIONS:
        sums = covered.select("bad", F.explode("bins").alias("b")).groupBy("b.name", "b.bin").agg(
            F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")
        ).collect()
        by: dict[str, dict[int, tuple[int, int]]] = {}
        for r in sums:
            by.setdefault(r["name"], {})[r["bin"]] = (r["p"], r["n"])
        one = next(iter(by.values()), {})
        p0, n0 = (sum(v[i] for v in one.values()) for i in (0, 1))
        if not p0 or not n0:
            break
        best = (0.0, None)
        for name in FEATURES:
            bins, low = by.get(name, {}), [0, 0]
            for k, cut in enumerate(cuts[name]):
                low = [low[i] + bins.get(k, (0, 0))[i] for i in (0, 1)]
                for sign, (p, n) in (("<=", low), (">", (p0 - low[0], n0 - low[1]))):
                    if p and p + n < p0 + n0:
                        gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                        best = max(best, (gain, (name, sign, cut)), key=lambda x: x[0])
        if best[1] is None:
            break
        name, sign, cut = best[1]
        # Halfway to the next value seen, so that the threshold is not a value of a document.
        value = of(name)
        near = covered.agg(F.max(F.when(value <= cut, value)).alias("low"), F.min(F.when(value > cut, value)).alias("high")).first()
        conditions.append((name, sign, (near.low + near.high) / 2))
        covered = covered.where(Rule((conditions[-1],)).column(of))
    return Rule(tuple(conditions)) if conditions else None


def _pruned(rule: Rule, left: DataFrame, of) -> tuple[Rule, list[tuple[int, int]]]:
    """The rule's beginning that does best on the pruning part; low and good documents it covers there and
    in the growing part."""
    heads = [Rule(rule.conditions[: k + 1]) for k in range(len(rule.conditions))]
    count = lambda r, bad, prune: F.count_if(
        r.column(of) & (F.col("bad") == bad) & (F.col("prune") == prune)
    )
    got = left.agg(
        *[count(r, bad, part).alias(f"c{k}_{bad}_{part}") for k, r in enumerate(heads) for bad in (True, False) for part in (True, False)]
    ).first()
    value = lambda k: [(got[f"c{k}_True_{part}"], got[f"c{k}_False_{part}"]) for part in (True, False)]
    worth = lambda k: ((x := value(k)[0])[0] - x[1]) / max(1, x[0] + x[1])
    best = max(range(len(heads)), key=lambda k: (worth(k), -k))
    return heads[best], value(best)


def labelled_rows(scored: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Join statistics with labels (quality 0 is low); a fifth of the documents, by hash, is for pruning.

    Labels with a null id or quality are left out; a document with contrary labels counts as low.
    """
    bad = labels.where("quality is not null").groupBy(id_column).agg((F.min("quality") == 0).alias("bad"))
    return scored.join(bad, id_column).select(
        F.col("f"), "bad", (F.pmod(F.xxhash64(F.col(id_column)), F.lit(5)) == 0).alias("prune")
    )


def verdict(rules: list[Rule], s: Column, f: Column) -> Column:
    """Number of the first rule that fires, 0 for the base rule, null for none: an ordered CASE."""
    out = F.when(base_failed(s), F.lit(0))
    for k, rule in enumerate(rules):
        out = out.when(rule.column(lambda name: f[name]), F.lit(k + 1))
    return out


def judge(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    keep_row: bool = True,
) -> DataFrame:
    """All columns of the documents as struct `row` (or the id alone), with the statistics, base_failed, rule
    (number in the list, 0 for the base rule, null if none fires), rule_text and kept.

    Defined cases: a null or empty text has no words and fails the base rule; null ids are judged like others
    and match no label; repeated rows get the same answer; extra columns of any name travel inside `row`; an empty
    table gives no row; without labels only the base rule decides.
    """
    # Rules are learned from ids and statistics alone: no text is shuffled, however many labels there are.
    measured = written(docs.select(F.col(id_column), statistics(text_or_empty(text_column)).alias("s")), "statistics")
    learned = labelled_rows(measured.withColumn("f", features(F.col("s"))), labels, id_column)
    if keep_row:
        plain = docs.select(F.struct("*").alias("row"), statistics(text_or_empty(text_column)).alias("s"))
    else:
        plain = measured.select(F.struct(F.col(id_column)).alias("row"), "s")
    rules = learn(learned)
    fired = plain.withColumn("rule", verdict(rules, F.col("s"), features(F.col("s"))))
    texts = F.array(F.lit("base"), *[F.lit(str(r)) for r in rules])
    return fired.select(
        "row", "s.*", base_failed(F.col("s")).alias("base_failed"), "rule",
        F.get(texts, F.col("rule")).alias("rule_text"), F.col("rule").isNull().alias("kept"),
    )
