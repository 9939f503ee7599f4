"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korridor.llm.common import cut, drop


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for each node of ``links`` (u, v: any comparable type).

    Alternates large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce
    and Beyond"): each hangs the neighbours of a node on the least of them, so the number of links
    never grows and paths shrink by a constant factor. Every round is written to the shared folder;
    the driver sees two numbers a round. The last links are stars: one row per node.
    """
    edges = cut(links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        # a node also hangs on its own least neighbour
        done = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u != v").distinct(), "links")
        drop(edges)
        edges = done
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
