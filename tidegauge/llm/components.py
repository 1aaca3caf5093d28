"""Connected components of links between integer ids, by smallest label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidegauge.llm.runtime import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``links`` (a, b) -> (id, component, old), kept in ``scratch``: the smallest id reachable, for every id that has a link.

    Each round takes the least label among an id's neighbours, then the label of that label, so that chains halve.
    Both are joins and partial minima; a hub's rows are split by the joins and pre-aggregated by the minima.
    """
    edges = scratch.keep(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch.keep(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        heard = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "id").select("id", F.least("component", "heard").alias("component"), F.col("component").alias("old"))
        target = nearer.select(F.col("id").alias("component"), F.col("component").alias("jump"))
        after = scratch.keep(nearer.join(target, "component", "left").select("id", F.least("component", "jump").alias("component"), "old"))
        scratch.drop(labels)
        labels = after
        if after.filter("component <> old").isEmpty():
            scratch.drop(edges)
            return labels
