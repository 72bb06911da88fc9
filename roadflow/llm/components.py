"""Connected components of an edge table, by smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Each round takes the smallest label among the neighbours (a partial aggregate, so the
    centre of a large star costs no more than its edges) and then jumps to the label of
    the label, which halves the way left. Labels are written to the shared folder each
    round: lost executors repeat one round at most.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "root")
        nearest = labels.select("node", "root", F.col("root").alias("old")).union(
            seen.select("node", "root", F.lit(None).cast(labels.schema["root"].dataType)))
        nearest = nearest.groupBy("node").agg(F.min("root").alias("next"), F.max("old").alias("old"))
        jump = labels.select(F.col("node").alias("next"), "root")
        after = nearest.join(jump, "next").select("node", F.least("next", "root").alias("root"), "old")
        after = stage(after, "labels")
        labels = after.select("node", "root")
        if after.where("root <> old").isEmpty():
            return labels
