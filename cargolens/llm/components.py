"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.llm.shared import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the smallest node of its component) of every node with a link.

    Each round hands every node the smallest label among its neighbours and its label's own
    label, until nothing changes; paths shorten by half or more in a round. Rounds are stored,
    so a lost executor costs no earlier round. An empty frame gives no rows.
    """
    both = links.select("src", "dst").union(links.select("dst", "src")).distinct()
    both = stored(both, "graph")
    nearest = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near"))
    labels = stored(nearest.select("node", F.least("node", "near").alias("label")), "labels")
    while True:
        names = labels.select(F.col("node").alias("dst"), F.col("label").alias("other"))
        offered = both.join(names, "dst").groupBy(F.col("src").alias("node")).agg(F.min("other").alias("other"))
        nearer = labels.join(offered, "node").select("node", "label", F.least("label", "other").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        after = nearer.join(jump, "near").select("node", F.least("near", "far").alias("label"), F.col("label").alias("old"))
        after = stored(after, "labels")
        if after.where("label <> old").isEmpty():
            return labels
        labels = after.select("node", "label")
