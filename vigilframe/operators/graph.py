"""Lineage graphs: reachability, cycles and components as joins that run to their fixpoint.

No number of rounds is built in: a result that isn't complete is never returned. Every round, or several of them, is
written to the shared folder, so plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.plans.shared import cut

#: Rounds of trimming between writes: each reads its edges three times, so the plan grows threefold with every one.
TRIMS = 2


def reachable(edges: DataFrame, start: DataFrame, hops: int | None = None) -> DataFrame:
    """Node and hops of everything that edges(src, dst) lead to from start(node), by breadth. hops: no further than
    that many steps; by default as far as edges go."""
    edges = edges.select("src", "dst").distinct()
    seen = cut(start.select("node").distinct().withColumn("hops", F.lit(0)))
    front, hop = seen, 0
    while hops is None or hop < hops:
        hop += 1
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(step.join(seen, "node", "left_anti").withColumn("hops", F.lit(hop)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if hop % 16 == 0:
            seen = cut(seen)
    return seen


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    """The edges that are left, and how many, when nodes without a way in or without a way out are taken away until none
    is: those on cycles and on ways between cycles."""
    n = edges.count()
    while n:
        for _ in range(TRIMS):
            ins, outs = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
            edges = edges.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst")
        edges = cut(edges)
        before, n = n, edges.count()
        if n == before:
            break
    return edges, n


def _settled(state: DataFrame, step, *columns: str) -> DataFrame:
    """state after as many steps as change it."""
    sums = [F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.count(F.lit(1))]
    state = cut(state)
    now = state.agg(*sums).first()
    while True:
        state = cut(step(state))
        before, now = now, state.agg(*sums).first()
        if now == before:
            return state


def on_cycles(edges: DataFrame) -> DataFrame:
    """The nodes that lie on a cycle of edges(src, dst), a node with an edge to itself among them.

    After trimming, strongly connected components: every node takes the largest node that leads to it as its colour; within
    a colour, what leads back to the node that gave it is one component. Components are taken away until no edge is left."""
    left, n = _trimmed(cut(edges.select("src", "dst").distinct()))
    found = None
    while n:
        both = left
        colour = both.select(F.col("src").alias("node")).union(both.select("dst")).distinct().withColumn("c", F.col("node"))

        def spread(now, both=both):
            more = now.withColumnRenamed("node", "src").join(both, "src").select(F.col("dst").alias("node"), "c")
            return now.unionByName(more).groupBy("node").agg(F.max("c").alias("c"))

        colour = _settled(colour, spread, "node", "c")
        inside = cut(both.join(colour.withColumnRenamed("node", "src"), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("c2")), "dst").filter("c = c2").select("src", "dst", "c"))

        def back(now, inside=inside):
            more = now.withColumnRenamed("node", "dst").join(inside, ["dst", "c"]).select(F.col("src").alias("node"), "c")
            return now.unionByName(more).distinct()

        members = _settled(colour.filter("node = c"), back, "node", "c")
        loops = both.filter("src = dst").select(F.col("src").alias("node")).distinct()
        several = members.groupBy("c").count().filter("count > 1").select("c")
        hit = members.join(several, "c", "left_semi").select("node").unionByName(members.join(loops, "node", "left_semi").select("node")).distinct()
        found = cut(hit if found is None else found.unionByName(hit))
        gone = members.select("node")
        left = both.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        left, n = _trimmed(cut(left))
    return left.select(F.col("src").alias("node")).distinct() if found is None else found


def labels(edges: DataFrame) -> DataFrame:
    """Node and component (its least node), by spreading the least label over undirected edges with shortcuts."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    now = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("c")).select(F.col("src").alias("node"), "c")

    def step(now):
        near = both.join(now, both["dst"] == now["node"]).groupBy("src").agg(F.min("c").alias("least"))
        hop = now.select(F.col("node").alias("c"), F.col("c").alias("up"))
        return now.join(near, now["node"] == near["src"], "left").join(hop, "c", "left").select("node", F.least("c", F.coalesce("least", "c"), F.coalesce("up", "c")).alias("c"))

    return _settled(now, step, "node", "c").select("node", F.col("c").alias("component"))
