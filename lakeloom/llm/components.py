"""Connected components of a table of links, without gathering them anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """node and component (the least node that it can reach) of each node of links (a, b).

    Each round takes the least label among neighbours, then the label of that label, so that a chain's
    length halves. Rounds are written to the shared folder, which cuts their lineage.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = materialise(both, "links")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = materialise(lower, "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        after = materialise(lower.join(jump, "label", "left").select("node", "was", F.least("label", "beyond").alias("label")), "labels")
        changed = after.where("label <> was").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "component")
