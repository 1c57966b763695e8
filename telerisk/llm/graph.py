"""Connected components of an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telerisk.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (its component's smallest node) of every node of ``edges(a, b)``.

    Each round takes the smallest label among a node and its neighbours, then the label of that
    label, and writes the labels to the shared folder, so that no round depends on an executor.
    Joins run on node ids and sums of a node's neighbours combine before the shuffle; a node with very
    many edges is left to the skew handling of adaptive joins.  Nothing but a count reaches the driver.
    Null ends, loops and repeated edges are ignored.
    """
    edges = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    both = materialise(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        near = (both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m")))
        lower = labels.join(near, "node").select("node", F.col("root").alias("was"), F.least("root", "m").alias("via"))
        step = labels.select(F.col("node").alias("via"), F.col("root").alias("jump"))
        found = materialise(lower.join(step, "via").select("node", "was", F.least("via", "jump").alias("root")), "labels")
        labels = found.select("node", "root")
        if found.where("root <> was").limit(1).count() == 0:
            return labels
