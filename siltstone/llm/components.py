"""Connected components by labels that spread along links and jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import discard, durable


def components(links: DataFrame) -> DataFrame:
    """``node, root`` of all nodes of ``links(a, b)``; the root is the smallest node reachable.

    A round is one job: a node takes the smallest of its label, its neighbours'
    labels and its label's label.  A hub's links are reduced by a partial
    minimum before they meet.
    """
    forth = links.where("a <> b").select("a", "b")
    both = durable(forth.unionByName(forth.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nearest = both.groupBy("a").agg(F.min("b").alias("b"))
    labels = durable(nearest.select(F.col("a").alias("node"), F.lit(None).cast(both.schema["a"].dataType).alias("before"), F.least("a", "b").alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        far = labels.select(F.col("node").alias("_of"), F.col("root").alias("far"))
        moved = labels.select("node", "root").join(near, F.col("node") == F.col("a")).join(far, F.col("root") == F.col("_of"), "left")
        moved = durable(
            moved.select("node", F.col("root").alias("before"), F.least("root", "near", F.coalesce("far", "root")).alias("root"))
        )
        discard(labels)
        labels = moved
        if moved.where("root <> before").isEmpty():
            discard(both)
            return labels
