"""Connected components of a link table, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``node, label`` (the component's smallest node) for every node of ``links`` (``a, b``).

    Each round takes the smallest label around a node, then the label's own
    label (pointer jumping), until nothing changes."""
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = staged(both, "cc_links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"))
    labels = staged(labels, "cc_labels")
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("_near"))
        step = labels.join(around, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        step = staged(step.join(up, "label", "left").select("node", "_old", F.least("label", F.coalesce("_up", "label")).alias("label")), "cc_labels")
        labels = step.select("node", "label")
        if not step.where("_old <> label").limit(1).count():
            return labels
