"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``links`` has a and b; gives node and root, the smallest node that it reaches. Lineage is cut at each round."""
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).filter("a != b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "b", "root": "r"}), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("near"))
        told = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("far"))
        told = cut_lineage(told.join(jump, "root").select("node", "old", F.least("root", "far").alias("root")))
        moved = told.filter("old != root").limit(1).count()
        labels = told.select("node", "root")
        if not moved:
            return labels
