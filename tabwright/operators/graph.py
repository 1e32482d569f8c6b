"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.session import cut_lineage


def connected(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b); the root is the smallest node that can be reached.

    Every round lowers a node's label to the smallest among its neighbours' and then to that label's own label, so paths
    shorten by doubling. Labels are combined map-side before they move, so a node with very many links costs no more than others.
    """
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.where("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("_a")).agg(F.min("root").alias("_low"))
        lowered = labels.join(near, F.col("node") == F.col("_a")).select("node", "root", F.least("root", "_low").alias("new"))
        above = labels.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        jumped = lowered.join(above, F.col("new") == F.col("_n"), "left").select("node", "root", F.coalesce("_r", "new").alias("new"))
        jumped = cut_lineage(jumped)
        labels = jumped.select("node", F.col("new").alias("root"))
        if jumped.where("root <> new").isEmpty():
            return labels
