"""Connected components of a table of links, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featlake.llm.common import written


def connected(links: DataFrame) -> DataFrame:
    """``node, label`` for every node in ``links`` (``a, b``): the smallest node that it reaches.

    Each round a node takes the smallest label among its neighbours, passes it on to the node that
    its old label names, and then follows its label's own label. Every step is a join of stored
    tables or an aggregate that is reduced before its shuffle, so a node with very many links is
    split; each round's labels are stored, so no round depends on the memory of an executor.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    edges = written(both, "links")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        seen = edges.join(labels, edges.b == labels.node).select(F.col("a").alias("node"), "label")
        lowest = labels.unionByName(seen).groupBy("node").agg(F.min("label").alias("new"))
        moved = labels.join(lowest, "node").where("new < label")
        hooked = moved.select(F.col("label").alias("node"), F.col("new").alias("label"))
        proposed = lowest.select("node", F.col("new").alias("label")).unionByName(hooked)
        parents = written(proposed.groupBy("node").agg(F.min("label").alias("label")), "labels")
        up = parents.select(F.col("node").alias("label"), F.col("label").alias("top"))
        after = written(parents.join(up, "label").select("node", F.col("top").alias("label")), "labels")
        changed = after.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old")
        if changed.isEmpty():
            return after
        labels = after
