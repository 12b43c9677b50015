"""Connected components by minimum labels, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.work import saved


def components(links: DataFrame) -> DataFrame:
    """Rows ``node, label`` for every node of ``links`` (a, b): the smallest node of its component.

    Each round takes the smallest label among a node's neighbours and then the label's own label,
    so stars need one round and a chain of n about log n. The labels of a round are written out;
    only the number of changed labels comes to the driver."""
    both = saved(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l"))
                   .select("node", F.least("node", "l").alias("label")), "labels")
    while True:
        near = (both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near")))
        met = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("met"))
        new = saved(met, "labels-met")
        jump = new.select(F.col("node").alias("at"), F.col("met").alias("further"))
        new = saved(new.join(jump, F.col("met") == F.col("at"), "left").select(
            "node", "old", F.least("met", "further").alias("label")), "labels-new")
        labels = new.select("node", "label")
        if not new.where("old <> label").limit(1).count():
            return labels
