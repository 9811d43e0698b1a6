"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the smallest node reachable from it.

    Every round a node takes the smallest label among its neighbours and then the label of that label, so chains
    shrink by half.  Minima are taken before the shuffle, and each round is written to the shared folder.
    """
    edges = store(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), "edges")
    labels = store(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        lower = store(labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root")), "labels")
        above = lower.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = store(lower.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), "old"), "labels")
        labels = jumped.select("node", "root")
        if jumped.filter("root <> old").isEmpty():
            return labels
