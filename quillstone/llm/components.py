"""Connected components by joins: smallest label of the neighbours, then pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.skew import joined_by_key
from quillstone.llm.staging import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """(node, comp), staged, for each end of the edges (a, b); comp is the smallest node of its component.

    Each round takes the smallest label among a node and its neighbours and then the
    label of that label.  It ends when no label changes.  Rows stay as narrow as an
    edge.  Nodes with very many edges, and labels of very many nodes, are joined apart
    from the others; labels are pre-aggregated before they are shuffled.
    """
    both = stage(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("u").alias("node")).agg(F.least("node", F.min("v")).alias("comp"), F.count(F.lit(1)).alias("degree")), "labels")
    while True:
        near = joined_by_key(both, labels.select(F.col("node").alias("v"), "comp", "degree"), "v", "degree").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        lower = stage(labels.join(near, "node").select("node", "degree", F.col("comp").alias("was"), F.least("comp", "near").alias("mid")), "lower")
        holders = lower.groupBy("mid").agg(F.count(F.lit(1)).alias("n"))
        target = stage(holders.join(lower.select(F.col("node").alias("mid"), F.col("mid").alias("far")), "mid"), "targets")
        jumped = stage(joined_by_key(lower, target, "mid", "n").select("node", "degree", "was", F.least("mid", "far").alias("comp")), "labels")
        changed = not jumped.where("comp <> was").isEmpty()
        discard(labels, lower, target)
        labels = jumped
        if not changed:
            discard(both)
            return labels.select("node", "comp")
