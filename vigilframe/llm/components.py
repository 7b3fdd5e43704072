"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.llm.util import materialize


def _least(pairs: DataFrame) -> DataFrame:
    """u, m: the least of each u's neighbours v and u itself."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the least node that edges(u, v) connect each node with. Nodes without an edge to another don't appear.

    Rounds run until nothing changes; each is written to the shared folder, so the plan stays short and a lost executor
    costs one round. Neighbour lists are never collected: a node's least neighbour is an aggregate, joined back to its
    edges, and Spark splits that join where a node has very many.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    e = materialize(e, "components")
    before = None
    for _ in range(most_rounds):
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = materialize(small.filter("u <> v").distinct(), "components")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
