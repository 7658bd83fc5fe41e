"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialise


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free digest of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                 .first())


def _stars(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the smallest of u and its neighbours. Minima are combined before their
    shuffle and written, so that a node with very many neighbours can be split in the join."""
    least = materialise(pairs.groupBy("u").agg(F.min("v").alias("m")), "least")
    return pairs.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node of the
    component. The number of rounds grows with the logarithm of the component sizes; not being done
    after ``max_rounds`` raises."""
    edges = materialise(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    for _ in range(max_rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = materialise(_stars(both).filter(F.col("v") > F.col("u"))
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        small = _stars(large)
        edges = materialise(
            small.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a != b")
            .unionAll(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
            .distinct(), "edges")
        last, state = state, _state(edges)
        if state == last:
            # stars now: every node but a root has one edge, to its root
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components not found in {max_rounds} rounds")
