"""Connected components as DataFrame contraction rounds; nothing is gathered on the driver."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm._common import written


def _rotated(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, 64 - by))


def _shuffled(n: int) -> tuple[int, int]:
    """Mask and rotation of round n: a reversible change of the nodes' order."""
    rng = random.Random(n)
    return rng.getrandbits(64) - (1 << 63), rng.randrange(1, 64)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node (a long) of the edges (a, b): root is the smallest node that can be reached.

    Each round sends every node to the first among its neighbours and itself, in an order that changes from round to
    round, and contracts the edges; about half of the nodes go, whatever the shape, so that the number of rounds is
    logarithmic. A hub's edges are reduced by partial aggregation; the joins have one row a node on one side, so that
    Spark can split a hub on the other.
    """
    edges = written(edges.filter("a <> b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        mask, by = _shuffled(len(maps))
        there = lambda x: _rotated(x.bitwiseXOR(F.lit(mask)), by)  # noqa: B023, E731
        back = lambda x: _rotated(x, 64 - by).bitwiseXOR(F.lit(mask))  # noqa: B023, E731
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(there(F.col("b"))).alias("to"))
        step = written(first.select(F.col("a").alias("node"), back(F.least("to", there(F.col("a")))).alias("root")), "parents")
        maps.append(step)
        at_a = edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        at_b = at_a.join(step.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = written(at_b.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # a node's image may move again in a later round: follow the maps from the last to the first
    out = maps[-1]
    for step in reversed(maps[:-1]):
        later = out.select(F.col("node").alias("via"), F.col("root").alias("last"))
        out = step.select("node", F.col("root").alias("via")).join(later, "via", "left").select("node", F.coalesce("last", "via").alias("root"))
    out = written(out, "roots")
    least = written(out.groupBy("root").agg(F.min("node").alias("least")), "least")
    return out.join(least, "root").select("node", F.col("least").alias("root"))
