"""Connected components by minimum labels, with hooking and shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolelens.session import ensure_checkpoint_dir


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of ``edges`` (a, b).

    Each round every node takes the smallest label around it, its old label's node takes that too, and
    labels are replaced by their own labels; long chains so shrink by a factor per round. Neighbours'
    labels are combined map-side; nothing holds a node's neighbours together.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = both.where("a <> b").distinct().checkpoint()
    label = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    label = label.select("node", F.least("node", "m").alias("root")).checkpoint()
    while True:
        around = (
            both.join(label.select(F.col("node").alias("b"), F.col("root").alias("other")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("other").alias("other"))
        )
        lower = label.join(around, "node").select("node", "root", F.least("root", "other").alias("low"))
        lower = lower.checkpoint()
        hooked = lower.select("node", "low").unionByName(lower.select(F.col("root").alias("node"), "low"))
        hooked = hooked.groupBy("node").agg(F.min("low").alias("low")).checkpoint()
        further = hooked.select(F.col("node").alias("low"), F.col("low").alias("next"))
        new = (
            hooked.join(further, "low", "left")
            .select("node", F.least("low", F.coalesce("next", "low")).alias("root"))
            .checkpoint()
        )
        changed = new.join(label.withColumnRenamed("root", "old"), "node").where("root <> old")
        label = new
        if changed.isEmpty():
            return label
