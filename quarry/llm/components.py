"""Connected components by label propagation with pointer jumping, on Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch, hot_join


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Rows (node, label) for every node that an edge (a, b) names; label: the least node reachable.

    Each round takes the least label among a node and its neighbours, then the label of that label. Labels of hubs go to
    all tasks (there are at most 1 / HOT_SHARE) and what their edges bring is added up in the tasks first, so a hub's edges
    never meet in one task. Rounds end when no label changes; tables of each round are
    written to the shared folder, and the one before is dropped. Empty edges give an empty table.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = scratch.save(both, f"{name}-edges")
    first = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"), F.count("*").alias("degree"))
    labels = scratch.save(first.select("node", F.least("node", "m").alias("label"), "degree"), f"{name}-0")
    rows, k = both.count(), 0
    while True:
        near = hot_join(both, labels.withColumnRenamed("node", "b"), ["b"], "degree", rows)
        seen = near.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("m"))
        low = labels.join(seen, "node").select("node", "label", "degree", F.least("label", "m").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        new = low.join(jump, "low", "left").select("node", "degree", F.least("low", F.coalesce("far", "low")).alias("label"), (F.least("low", F.coalesce("far", "low")) != F.col("label")).alias("changed"))
        k += 1
        new = scratch.save(new, f"{name}-{k}")
        done = new.where("changed").limit(1).count() == 0
        scratch.drop(f"{name}-{k - 1}")
        labels = new.select("node", "label", "degree")
        if done:
            scratch.drop(f"{name}-edges")
            return labels.drop("degree")
