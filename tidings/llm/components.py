"""Connected components of links between integer ids, by distributed minimum labels with hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import dropped, written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """u, label: each id that a link (u, v) names, with the smallest id reachable from it.

    A round gives each id the smallest label among its neighbours, hands the smallest of these within a group of equal
    labels to the id that names the group, and takes the label's label. So groups merge whole and rounds grow with
    the logarithm of the longest path. The loop ends when no label changes; should `rounds` not suffice, it raises. The
    tables of a round go to the shared folder; the driver sees only how many labels changed. Links should come as few
    as connect their groups (a forest), for the work of a round follows their number."""
    both = written(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    for _ in range(rounds):
        near = both.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        own = labels.join(near, "u").select("u", F.col("label").alias("old"), "near")
        hook = own.groupBy(F.col("old").alias("u")).agg(F.min("near").alias("hook"))
        best = own.join(hook, "u", "left").select("u", "old", F.least("old", "near", "hook").alias("best"))
        jump = labels.select(F.col("u").alias("best"), F.col("label").alias("far"))
        fresh = best.join(jump, "best").select("u", "old", F.least("best", "far").alias("label"))
        fresh = written(fresh, "labels")
        changed = fresh.filter("old <> label").limit(1).count()
        dropped(labels)
        labels = fresh.select("u", "label")
        if not changed:
            break
    else:
        raise RuntimeError(f"labels of components still change after {rounds} rounds")
    dropped(both)
    return labels
