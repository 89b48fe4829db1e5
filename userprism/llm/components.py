"""Connected components of an edge table by alternating large and small stars.

Each round links nodes to the smallest neighbour they know, first larger neighbours, then
smaller ones, until nothing changes; the number of rounds grows with the logarithm of the
longest path. A hub with very many edges is only ever the key of an aggregate or of a lookup of
one row, which keeps hot keys out of the shuffle. Rounds are written to the shared folder, so
lineage stays short and a lost executor costs one round.
"""

from pyspark.sql import functions as F

from ..operators.scale import lookup_join, stage


def _large(edges):
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
    return lookup_join(both.filter("v > u"), least, "u", "inner").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges):
    """Edges point from a larger a to a smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = lookup_join(edges, least, "a", "inner").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges):
    """(node, component) of every node on an edge (a, b); a component is its smallest node."""
    edges = stage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(edges)
    while True:
        edges = stage(_small(stage(_large(edges))))
        before, state = state, _state(edges)
        if state == before:
            break
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
