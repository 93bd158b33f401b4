"""Connected components of links between ids, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.session import cut_lineage


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links to (node, component): the least id that a node reaches.

    A round takes the least label among a node and its neighbours, then the label of that label.
    Rows are sums over keys or keyed lookups, so a node of many links is no single task's work.
    """
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in range(max_rounds):
        # least label of the neighbours
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
        least = cut_lineage(least)
        # a root that sees a smaller label passes it on to all who point at it
        offers = least.filter("least < label").groupBy(F.col("label").alias("node")).agg(F.min("least").alias("offer"))
        hooked = least.join(offers, "node", "left").select("node", "label", F.least("least", F.coalesce("offer", "least")).alias("least"))
        hooked = cut_lineage(hooked)
        up = hooked.select(F.col("node").alias("least"), F.col("least").alias("up"))
        moved = cut_lineage(hooked.join(up, "least", "left").select("node", "label", F.least("least", F.coalesce("up", "least")).alias("next")))
        changed = moved.filter("next <> label").limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError("components did not settle")
