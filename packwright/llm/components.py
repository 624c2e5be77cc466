"""Connected components of a graph that no single machine could hold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(node, comp) for every node of the links (a, b): comp is the smallest node that can be reached.

    Each round, every component takes its smallest neighbour as parent, chains of parents are shortened by
    joining the parents with themselves, and links are rewritten to the roots; links inside a component go.
    The number of components at least halves with each round, so there are at most log2(nodes) rounds. A node
    of many links is one group of a minimum, which is summed up before the shuffle.
    """
    live = keep(links.where("a <> b").select("a", "b").distinct(), "links")
    labels = None
    while not live.isEmpty():
        both = live.union(live.select(F.col("b"), F.col("a")))
        parent = keep(
            both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p"))
            .select("node", F.least("node", "p").alias("p")),
            "parents",
        )
        while True:
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            jumped = keep(parent.join(up, "p").select("node", "p", "pp"), "parents")
            done = jumped.where("p <> pp").isEmpty()
            parent = jumped.select("node", F.col("pp").alias("p"))
            if done:
                break
        if labels is None:
            labels = parent.select("node", F.col("p").alias("comp"))
        else:
            moved = parent.select(F.col("node").alias("comp"), "p")
            labels = labels.join(moved, "comp", "left").select(
                "node", F.coalesce("p", "comp").alias("comp")
            )
        labels = keep(labels, "labels")
        a = parent.select(F.col("node").alias("a"), F.col("p").alias("pa"))
        b = parent.select(F.col("node").alias("b"), F.col("p").alias("pb"))
        live = keep(
            live.join(a, "a").join(b, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "links",
        )
    return live.select(F.col("a").alias("node"), F.col("b").alias("comp")) if labels is None else labels
