"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaymark.llm.common import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label) from edges (a, b), as a table of the shared folder: label is the least node of the component. Each round takes the least label next door and then that label's own; a node of any degree leaves one row for each map task."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jumps = labels.select(F.col("node").alias("mid"), F.col("label").alias("jump"))
        now = written(lower.join(jumps, "mid", "left").select("node", "old", F.least("mid", F.coalesce("jump", "mid")).alias("label")), "labels")
        discard(labels)
        if now.where("old != label").isEmpty():
            discard(both)
            return now
        labels = now
