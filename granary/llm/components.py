"""Connected components of an edge table by alternating star contractions, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, component`` for every node of the undirected edges ``a, b`` (longs); the component is its smallest node.

    Each round joins every node to the smallest label among its neighbours, then follows labels once (pointer jumping), so that the
    number of rounds grows with the logarithm of the longest path.  Tables between rounds are stored in the shared folder.
    Nulls and self loops are ignored; an empty table gives an empty result.
    """
    edges = edges.where("a <> b").select("a", "b")
    both = stash(edges.union(edges.select("b", "a")).toDF("node", "other").distinct(), "edges")
    labels = stash(both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.toDF("other", "label"), "other").groupBy("node").agg(F.min("label").alias("label"))
        lower = labels.join(near, "node").select("node", "component", F.least("component", "label").alias("label"))
        # the old label's own node also hears of the smaller one (hooking), which joins whole trees at once
        hooks = lower.where("label < component").groupBy(F.col("component").alias("node")).agg(F.min("label").alias("hook"))
        hooked = lower.join(hooks, "node", "left").select("node", "component", F.least("label", F.coalesce("hook", "label")).alias("label"))
        hooked = stash(hooked, "labels")
        jumped = hooked.join(hooked.select(F.col("node").alias("label"), F.col("label").alias("far")), "label", "left")
        now = stash(jumped.select("node", F.least("label", F.coalesce("far", "label")).alias("component"), (F.least("label", F.coalesce("far", "label")) < F.col("component")).alias("moved")), "labels")
        moved = now.where("moved").limit(1).count()
        labels = now.select("node", "component")
        if not moved:
            break
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    return labels
