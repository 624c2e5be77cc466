"""Collocations against plain Python on odd rows and small bounds."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pytest

from packwright.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, n double, phrase string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rows():
    rng = random.Random(8)
    words = ["ab", "Cd", "éÉ", "x-y", "x-y", "中", "\x00", "\x1c"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", "\x0b", "?!"]
    text = lambda n: "".join(rng.choice(words) + rng.choice(ends) for _ in range(n))
    texts = [None, "", " \t\n", "ab", *[text(rng.randint(0, 40)) for _ in range(80)], text(9000), "ab cd " * 200, "p q r s t. " * 30]
    rows = [(i, t, rng.choice(["en", "de", None]), 1.0, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20], (None, texts[9], "en", None, None)]


def _plain(rows, longest, least, first, covered):
    counts, totals = collections.Counter(), collections.Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    often = {key: n for key, n in counts.items() if n >= least and len(key[1]) > 1}
    longer = collections.Counter()
    for (lang, w), n in often.items():
        for s in range(2, len(w)):
            for i in range(len(w) - s + 1):
                key = lang, w[i : i + s]
                longer[key] = max(longer[key], n)
    out = collections.defaultdict(list)
    for (lang, w), a in often.items():
        if longer[lang, w] and 100 * longer[lang, w] >= covered * a:
            continue
        n = totals[lang]
        cuts = []
        for k in range(1, len(w)):
            left, right = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((1000 * a * n // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(w).encode(), left, right, n))
    return [
        (lang, rank, phrase.decode(), -a, left, right, n, -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right, n) in enumerate(sorted(found)[:first], 1)
    ]


@pytest.mark.parametrize("longest, least, first, covered", [(5, 3, 2000, 100), (5, 2, 7, 60), (3, 5, 50, 100), (2, 2, 2000, 100)])
def test_like_plain_python(spark, longest, least, first, covered):
    docs = spark.createDataFrame(_rows(), SCHEMA).repartition(4)
    got = c.collocations(docs, longest=longest, least=least, first=first, covered=covered)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(_plain(_rows(), longest, least, first, covered))


def test_nothing_to_find(spark):
    for rows in ([], [(1, None, None, None, None)], [(1, "a b c", "en", None, None)]):
        assert c.collocations(spark.createDataFrame(rows, SCHEMA)).collect() == []


def test_equal_fingerprints_are_told_apart_and_filters_only_let_more_through(spark, monkeypatch):
    """With every run let through and few bits of the fingerprint alike, the answer is the same."""
    rows = [r for r in _rows() if r[1] and len(r[1]) < 300]
    want = sorted(_plain(rows, 4, 2, 2000, 100))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    full = lambda frequent: np.full(1 << 10, ~np.uint64(0))
    monkeypatch.setattr(c, "frequent_filter", full)
    assert sorted(map(tuple, c.collocations(docs, longest=4, least=2).collect())) == want


def test_products_may_pass_64_bits(spark):
    exact = spark.sql(
        "SELECT (cast(1000 * a as decimal(19,0)) * cast(w as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0))) AS s "
        "FROM VALUES (9000000000000L, 800000000000000L, 90000000000001L, 70000000000000L) AS t(a, w, l, r)"
    ).first().s
    assert exact == 1000 * 9000000000000 * 800000000000000 // (90000000000001 * 70000000000000)
