"""Connected components of an undirected graph as joins over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``links`` (columns a, b); a component is its smallest node.

    Each round takes the smallest label among the neighbours and then the label of that label, so labels also jump
    along paths. Rounds end when nothing changes. Labels are written to shared storage after every round.
    """
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("at")).agg(F.min("component").alias("least"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("root"))
        moved = labels.join(near, F.col("node") == F.col("at"), "left").select("node", "component", F.least("component", "least").alias("step"))
        moved = moved.join(jump, F.col("step") == F.col("via"), "left").select("node", "component", F.least("step", F.coalesce("root", "step")).alias("next"))
        moved = materialize(moved, "labels")
        labels = moved.select("node", F.col("next").alias("component"))
        if moved.where("next <> component").isEmpty():
            return labels
