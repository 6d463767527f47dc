"""Connected components by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelspark.session import checkpoint


def labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) with the smallest node of each component; `nodes` has node, `edges` a and b (integers).

    Every round hooks a node, and the node it points to, to the smallest pointer seen among its neighbours, then
    pointers jump; so the rounds grow with the logarithm of the longest chain. A round is written to
    the checkpoint folder. Nodes whose pointer cannot sink further leave nothing to join but one row each.
    """
    both = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    state = checkpoint(nodes.select("node", F.col("node").alias("label")).distinct())
    while True:
        jumped = state.join(state.select(F.col("node").alias("label"), F.col("label").alias("far")), "label")
        least = both.join(jumped.select(F.col("node").alias("b"), "far"), "b").groupBy("a").agg(F.min("far").alias("near"))
        met = jumped.join(least.withColumnRenamed("a", "node"), "node", "left").withColumn("near", F.least("near", "far"))
        hooks = met.select("node", F.col("near").alias("label")).unionByName(met.select(F.col("label").alias("node"), F.col("near").alias("label")))
        after = checkpoint(hooks.groupBy("node").agg(F.min("label").alias("label")))
        if after.join(state.withColumnRenamed("label", "was"), "node").where("label <> was").isEmpty():
            return after
        state = after
