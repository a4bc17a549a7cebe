"""Connected components of an edge table by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """edges(a, b) -> (node, component): component is the smallest node reachable.

    Every round takes the least label among a node and its neighbours (a partially aggregated minimum,
    so a node of many edges is no burden), then jumps to the label of that label; a chain of n nodes
    settles in about log n rounds. Each round is written, so a lost executor costs one round.
    """
    e = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"))  # read twice
    e = written(e.union(e.select("v", "u")).distinct())
    labels = written(e.groupBy("u").agg(F.least("u", F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"))
    while True:
        near = e.join(labels, e["v"] == labels["node"]).select(F.col("u").alias("node"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        low = labels.select("node", "label", F.col("label").alias("was")).union(near).groupBy("node").agg(F.min("label").alias("label"), F.min("was").alias("was"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = written(low.join(up, "label", "left").select("node", F.least("label", "above").alias("label"), "was"))
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels.withColumnRenamed("label", "component")
