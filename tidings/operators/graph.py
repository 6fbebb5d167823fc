"""Graphs of stories: components, bounded breadth-first search, typed edges and their life."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidings.operators.joins import both_ways
from tidings.tables import saved, shared_folder  # noqa: F401


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, label: the smallest node reachable from each (CL2), by minimum labels with hooking and pointer jumping.

    The loop ends when no label changes; should `rounds` not suffice, it raises."""
    both = saved(both_ways(edges).select("node", "other").distinct())
    labels = saved(nodes.select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        own = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), "near")
        hook = own.groupBy(F.col("old").alias("node")).agg(F.min("near").alias("hook"))
        best = own.join(hook, "node", "left").select("node", "old", F.least("old", "near", "hook").alias("best"))
        jump = labels.select(F.col("node").alias("best"), F.col("label").alias("far"))
        labels_next = saved(best.join(jump, "best").select("node", "old", F.least("best", "far").alias("label")))
        changed = labels_next.filter("old <> label").limit(1).count()
        labels = labels_next.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError(f"labels of components still change after {rounds} rounds")


def strongest(edges: DataFrame, per_node: int) -> DataFrame:
    """node, other, weight: each node's edges of most weight, at most per_node (TK2)."""
    w = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    return both_ways(edges).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_node).drop("r")


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int, per_node: int = 12) -> DataFrame:
    """root, node, depth: what bounded breadth-first search reaches from each root (GR4), at its smallest depth.

    The loop is over depth (at most 3 in practice); each step is one join with the strongest edges."""
    out = strongest(edges, per_node).select("node", "other")
    seen = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    front = seen
    for k in range(1, depth + 1):
        fresh = front.join(out, "node").select("root", F.col("other").alias("node"), F.lit(k).alias("depth")).distinct()
        front = fresh.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        seen = seen.unionByName(front)
    return seen


def related(pairs: DataFrame, per_story: int = 6) -> DataFrame:
    """a < b, weight: edges 'related' (GR1): a pair stays if it is among the best of either end."""
    w = Window.partitionBy("node").orderBy(F.desc("weight"), "other")
    ranked = both_ways(pairs.select("a", "b", F.col("sim").alias("weight"))).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= per_story)
    return ranked.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "weight").distinct()


def current_edges(rules: DataFrame, agents: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rule edges as of now and agents' edges, without rejected pairs (GR3, GR6). Columns a, b, kind, weight.

    Recomputing rule edges removes stale ones; an agent's edge of the same pair and kind wins."""
    agents = agents.filter(F.col("kind").isin("causes", "responds_to", "escalates", "part_of", "contradicts", "parallels"))
    tagged = rules.withColumn("by", F.lit(1)).unionByName(agents.withColumn("by", F.lit(0)))
    tagged = tagged.withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
    tagged = tagged.join(rejected.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    w = Window.partitionBy("a", "b", "kind").orderBy("by", F.desc("weight"))
    return tagged.withColumn("r", F.row_number().over(w)).filter("r = 1").select("a", "b", "kind", "weight")
