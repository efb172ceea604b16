"""Connected components of links between longs, by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm._shared import dropped, written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b): the smallest id it reaches.

    Each round gives an id the smallest label among its neighbours and then that label's own
    label, so the rounds grow with the logarithm of a component's width.  Labels are written to
    the shared folder after each round; nothing but their count of changes reaches the driver.
    """
    pairs = written(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "links")
    labels = written(pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = pairs.join(labels, pairs["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        best = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "near").alias("best"), F.col("component").alias("old"))
        jump = labels.select(F.col("id").alias("best"), F.col("component").alias("further"))
        after = written(best.join(jump, "best").select("id", F.least("best", "further").alias("component"), "old"), "labels")
        changed = after.where("component <> old").limit(1).count()
        dropped(labels)
        labels = after.select("id", "component")
        if not changed:
            dropped(pairs)
            return labels
