"""Connected components of an edge table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, comp): the smallest node reachable, for every node with an edge. Each turn takes
    the smallest label of the neighbours and then the label's own label, so long chains shrink quickly."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        hop = labels.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        step = cut(step.join(hop, "comp", "left").select("node", "was", F.least("comp", F.coalesce("next", "comp")).alias("comp")))
        moved = step.filter("comp != was").limit(1).count()
        drop(labels)
        labels = step.select("node", "comp")
        labels._tapeloom_path = step._tapeloom_path
        if not moved:
            drop(both)
            return labels
