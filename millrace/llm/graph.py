"""Connected components of an edge table, by smallest labels and pointer jumping."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component) for every node of ``edges`` (a, b).

    Each round takes the smallest label among a node's own and its neighbours', then the label of that label, so paths halve. Only the
    number of changes reaches the driver. Rounds are written to the shared folder, which cuts the lineage.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        step = stored(step, "labels")
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("next"))
        joined = stored(step.join(jump, "new").select("node", F.least("new", "next").alias("label"), "old"), "labels")
        if not joined.where(F.col("label") != F.col("old")).take(1):
            return joined.select("node", "label")
        labels = joined.select("node", "label")


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node, label) after ``edges`` (a, b) between nodes have joined their groups; components are found over groups alone."""
    ends = edges.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b").where("la != lb")
    ends = stored(ends.select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "joins")
    if not ends.take(1):
        return labels
    moved = components(ends).toDF("label", "to")
    return stored(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
