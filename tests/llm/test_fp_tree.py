"""Ranked search against plain Python on odd rows, and the tree's own promises."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest

from packwright.llm import fp_tree as f

SCHEMA = "doc_id long, text string, rank int, score string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _text(rng, n):
    words = ["the", "The", "of", "é", "É", "x1", "中文", "rare%d" % rng.randint(0, 60), "r-s"]
    return "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "\x00", "_", "\x7f"]) for _ in range(n))


def _docs():
    rng = random.Random(4)
    texts = [None, "", " .,", "the", *[_text(rng, rng.randint(1, 60)) for _ in range(250)], _text(rng, 20_000)]
    copy = _text(rng, 40)
    rows = [(i, t, 1, "clash") for i, t in enumerate([*texts, *[copy] * 120])]
    rng.shuffle(rows)
    return [*rows, (None, copy, 1, None), (None, None, None, None), (77, _text(rng, 9), 2, "again"), rows[3], rows[3]]


def _items():
    rng = random.Random(5)
    rows = [(i, _text(rng, rng.randint(1, 30))) for i in range(25)]
    return [*rows, (90, None), (91, ""), (92, "nowhere to be found"), (None, "the of"), (93, _docs()[-4][1]), rows[2], rows[2], (94, _text(rng, 900))]


def _terms(text):
    return TERM.findall((text or "").translate(LOWER))


def _plain(items, docs, k):
    found = [(d[0], collections.Counter(_terms(d[1]))) for d in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, n_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in found:
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(_terms(text)) if t in c
            )
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k, entries, block", [(10, 1_000_000, 1 << 20), (3, 200, 1 << 20), (200, 900, 300)])
def test_like_plain_python(spark, monkeypatch, k, entries, block):
    monkeypatch.setattr(f, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(_docs(), SCHEMA).repartition(3)
    items = spark.createDataFrame(_items(), "item_id int, text string")
    got = f.rank_documents(items, docs, k=k, tree_entries=entries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == _plain(_items(), _docs(), k)


def test_nothing_to_rank(spark):
    docs, items = spark.createDataFrame(_docs()[:9], SCHEMA), spark.createDataFrame(_items(), "item_id int, text string")
    assert f.rank_documents(items.limit(0), docs).collect() == []
    assert f.rank_documents(items, docs.limit(0)).collect() == []
    assert f.rank_documents(items.where("text is null"), docs).collect() == []


@pytest.mark.parametrize("seed", range(5))
@pytest.mark.parametrize("leaf", [1, 4, 32])
def test_bounds_hold_and_the_search_is_exact(monkeypatch, seed, leaf):
    monkeypatch.setattr(f, "LEAF_DOCS", leaf)
    rng = np.random.default_rng(seed)
    vectors = []
    for _ in range(rng.integers(1, 400)):
        t = np.flatnonzero(rng.random(30) < rng.random()).astype(np.int32)
        if len(t):
            vectors.append((t, rng.integers(1, 9, len(t)), int(rng.integers(10, 300))))
    vectors += vectors[: len(vectors) // 3]
    df = np.bincount(np.concatenate([t for t, _, _ in vectors]), minlength=30)
    place = np.empty(30, np.int64)
    place[np.argsort(-df, kind="stable")] = np.arange(30)
    top, order = f.tree(vectors, place)
    assert sorted(order) == list(range(len(vectors)))
    weights = rng.integers(0, 5000, 30) * (rng.random(30) < 0.4)
    exact = [int(sum(weights[t] * f.parts(tf, np.int64(m)))) for t, tf, m in vectors]
    seen, looked = [], []

    def below(node, bound):
        bounds = node.bounds(weights)
        looked.append(node)
        assert bound is None or (bounds <= bound).all()
        if node.children is None:
            seen.extend((order[node.first + i], int(b)) for i, b in enumerate(bounds))
        else:
            for child, b in zip(node.children, bounds, strict=True):
                below(child, b)

    below(top, None)
    assert sorted(seen) == list(enumerate(exact))
    got = f.search(top, weights, order, [], 10)
    assert got == sorted((-s, False, i) for i, s in enumerate(exact) if s > 0)[:10]


def test_the_search_leaves_most_of_a_tree_out(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = [(np.sort(rng.choice(500, 12, replace=False)).astype(np.int32), np.ones(12, np.int64), 100) for _ in range(5000)]
    top, order = f.tree(vectors, np.arange(500))
    looked, bounds = [], f.Node.bounds
    monkeypatch.setattr(f.Node, "bounds", lambda self, w: (looked.append(self.children is None), bounds(self, w))[1])
    weights = np.zeros(500, np.int64)
    weights[vectors[7][0]] = 1000
    assert f.search(top, weights, order, [], 1)[0][2] in [i for i, v in enumerate(vectors) if (v[0] == vectors[7][0]).all()]
    assert sum(looked) < 5000 / f.LEAF_DOCS / 2
