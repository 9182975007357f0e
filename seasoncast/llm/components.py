"""Connected components of an edge table by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasoncast.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, component)``, the least id reachable, for every id in an edge.

    Each round takes the least label among the neighbours (a map-side minimum,
    so a hub is a row per task) and then the label's own label; rounds grow with
    the logarithm of the longest path.  Tables are written between rounds.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = materialise(labels.join(near, labels["id"] == near["a"])
                             .select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")), "hooked")
        jump = hooked.select(F.col("id").alias("label"), F.col("label").alias("next"))
        moved = materialise(hooked.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
        labels = moved.select("id", "label")
        if not moved.where("label <> old").limit(1).count():
            return labels.select("id", F.col("label").alias("component"))
