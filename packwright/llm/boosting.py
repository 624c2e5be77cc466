"""Gradient boosted trees: small enough to travel with a job, learned from arrays or from a whole Spark table."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documented size of a model.
TREES, DEPTH, RATE, BINS = 40, 3, 0.3, 32
#: Feature values are whole numbers; those from here on are never told apart, so a feature has few values.
LARGEST = 1024
#: Gradients are summed as whole numbers of this unit, so that a sum does not depend on its order.
UNIT = 2.0**-24


@dataclass
class Boosted:
    """Sum of trees over binned features, as log odds; without examples of both kinds it is constant."""

    base: float = -20.0
    cuts: list[np.ndarray] = field(default_factory=list)
    # A tree: for each level the (feature, bin) of its nodes, then the leaf values.
    trees: list[tuple[list[np.ndarray], np.ndarray]] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(self.cuts)], axis=1)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        return self.log_odds_binned(self.binned(x)) if self.trees and len(x) else np.full(len(x), self.base)

    def log_odds_binned(self, b: np.ndarray) -> np.ndarray:
        out = np.full(len(b), self.base)
        for levels, leaves in self.trees:
            out += RATE * leaves[_node(levels, b)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -30, 30)))


def _node(levels: list[np.ndarray], b: np.ndarray) -> np.ndarray:
    node = np.zeros(len(b), np.int64)
    rows = np.arange(len(b))
    for level in levels:
        node = 2 * node + (b[rows, level[node, 0]] > level[node, 1])
    return node


def _sums(model: Boosted, levels: list[np.ndarray], x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Gradient and curvature, in UNITs, of examples that count n times: (2, nodes, features, BINS)."""
    b = model.binned(x)
    p = 1 / (1 + np.exp(-model.log_odds_binned(b)))
    node, nodes = _node(levels, b), 1 << len(levels)
    out = np.zeros((2, nodes, b.shape[1], BINS), np.int64)
    for k, v in enumerate((y - p, np.maximum(p * (1 - p), 1e-6))):
        units = np.rint(v / UNIT).astype(np.int64) * n
        for f in range(b.shape[1]):
            np.add.at(out[k, :, f], (node, b[:, f]), units)
    return out


def _grown(base: float, cuts: list[np.ndarray], sums: Callable[[Boosted, list[np.ndarray]], np.ndarray]) -> Boosted:
    """Logistic loss, Newton leaves, one best split per node and level."""
    model = Boosted(base, cuts)
    for _ in range(TREES):
        levels: list[np.ndarray] = []
        for _ in range(DEPTH):
            g, h = sums(model, levels) * UNIT
            gs, hs = g.cumsum(axis=2), h.cumsum(axis=2)
            left, right = gs**2 / (hs + 1), (gs[..., -1:] - gs) ** 2 / (hs[..., -1:] - hs + 1)
            at = (left + right).reshape(len(g), -1).argmax(axis=1)
            levels.append(np.stack([at // BINS, at % BINS], axis=1))
        # What falls to each side of the last splits is in their sums.
        nodes = np.arange(len(gs))
        g, h = (np.stack([s[nodes, at // BINS, at % BINS], s[nodes, at // BINS, -1]], axis=1) for s in (gs, hs))
        g[:, 1], h[:, 1] = g[:, 1] - g[:, 0], h[:, 1] - h[:, 0]
        model.trees.append((levels, (g / (h + 1)).ravel()))
    return model


def _base(positive: float, total: float) -> float:
    return float(np.log(positive / (total - positive)))


def fit(x: np.ndarray, y: np.ndarray) -> Boosted:
    """A model of these examples."""
    positive = float(y.sum())
    if not 0 < positive < len(y):
        return Boosted(base=20.0 if positive else -20.0)
    values = [np.unique(c, return_counts=True) for c in np.minimum(x, LARGEST).T]
    n = np.ones(len(y), np.int64)
    return _grown(_base(positive, len(y)), [_cuts(*v) for v in values], lambda model, levels: _sums(model, levels, x, y, n))


def _cuts(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Quantiles of sorted values that count so many times."""
    total = counts.sum()
    at = np.floor(np.linspace(0, 1, BINS + 1)[1:-1] * (total - 1))
    cuts = np.unique(values[np.searchsorted(counts.cumsum(), at, "right")])
    return cuts[cuts < LARGEST]


def fit_table(examples: DataFrame) -> Boosted:
    """A model of all rows (x, y, n): features, 0 or 1, and how often. Each level of a tree is one pass over the
    rows, of which each task hands on its sums alone; cuts are quantiles of all values."""
    about = examples.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("y")).alias("positive")).first()
    positive, total = about.positive or 0, about.n or 0
    if not 0 < positive < total:
        return Boosted(base=20.0 if positive else -20.0)
    found = examples.select("n", F.posexplode("x").alias("f", "v")).groupBy("f", F.least("v", F.lit(float(LARGEST))).alias("v"))
    by_feature: dict[int, list] = {}
    for r in found.agg(F.sum("n").alias("n")).orderBy("f", "v").collect():
        by_feature.setdefault(r.f, []).append((r.v, r.n))
    cuts = [_cuts(np.array([v for v, _ in vs]), np.array([n for _, n in vs])) for _, vs in sorted(by_feature.items())]

    def sums(model: Boosted, levels: list[np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if batch.num_rows:
                    y, n = (batch.column(c).to_numpy() for c in ("y", "n"))
                    part = _sums(model, levels, feature_rows(batch), y, n)
                    out = part if out is None else out + part
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        parts = examples.select("x", "y", "n").mapInArrow(run, "sums binary").collect()
        shape = (2, 1 << len(levels), len(cuts), BINS)
        return sum((np.frombuffer(r.sums, np.int64).reshape(shape) for r in parts), np.zeros(shape, np.int64))

    return _grown(_base(positive, total), cuts, sums)


def feature_rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
