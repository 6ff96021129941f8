"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, dropped, written

#: Neighbours of a node that one task joins, at most.
HUB = 200_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds until the edges stay as they are; then each node hangs on its
    component's smallest. The number of rounds grows with the logarithm of the largest component. Neighbourhoods
    are only reduced to their minimum and joined back, never gathered; those of a hub are dealt out to many tasks. Loops,
    repeated edges and nulls are allowed; without edges the result is empty.
    """
    cols = [F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")]
    now = written(edges.select(cols).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before, total = None, now.count()

    def onto_least(edges: DataFrame, rows: DataFrame) -> DataFrame:
        """rows (u, v) with m, the smallest of u and its neighbours in edges."""
        least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        if total <= HUB // 2:  # no node can have more neighbours
            return rows.join(least.drop("n"), "u")
        least = written(least, "least")
        spare.append(least)
        return dealt(rows, least.drop("n"), ["u"], "v", least, HUB)

    while True:
        spare: list[DataFrame] = []
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = onto_least(both, both.where("v > u")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large")
        small = onto_least(large, large).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = large.groupBy("u").agg(F.min("v").alias("v"))
        last, now = now, written(small.unionByName(hung).distinct(), "small")
        dropped(last, large, *spare)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if seen == before:
            break
        before, total = seen, seen[0]
    roots = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
