"""Connected components of an edge table, by least labels and pointer jumping, in written rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import Workspace


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """node, component (least node reachable) of the nodes in edges (a, b).

    A round gives each node the least label among itself and its neighbours, then the label of that label. A hub
    with a third of all nodes is one key of a partly aggregated minimum and of a join, which Spark splits.
    """
    both = ws.table(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = ws.table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("_near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("_was"), F.least("component", "_near").alias("component"))
        to = step.select(F.col("node").alias("_to"), F.col("component").alias("_next"))
        new = ws.table(step.join(to, F.col("component") == F.col("_to"), "left").select("node", "_was", F.least("component", "_next").alias("component")))
        moved = new.where("component <> _was").limit(1).count()
        ws.drop(labels)
        labels = new.select("node", "component")
        if not moved:
            ws.drop(both)
            return labels
