"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, label): each vertex of the links with the smallest vertex that it reaches.

    Each round takes the least label among a vertex and its neighbours and then the label of that label (pointer
    jumping), so chains shrink by half. Every round is written to the shared folder; it ends when nothing changes.
    """
    both = links.select(F.col(a).alias("v"), F.col(b).alias("w"))
    edges = stored(both.unionByName(both.select(F.col("w").alias("v"), F.col("v").alias("w"))), "links")
    labels = stored(edges.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("v", "w"), "w").groupBy("v").agg(F.min("label").alias("near"))
        least = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("v").alias("next"), F.col("label").alias("far"))
        after = least.join(jump, "next").select("v", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved"))
        after = stored(after, "labels")
        labels = after.select("v", "label")
        if after.where("moved").isEmpty():
            return labels
