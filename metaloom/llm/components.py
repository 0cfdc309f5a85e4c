"""Connected components of links by smallest label, with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.session import cut, discard


def components(links: DataFrame) -> DataFrame:
    """``links``: columns a, b. Returns ``node, label`` (and ``moved``, false) for each node of a link, as a cut table; label is the smallest node reachable."""
    both = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a != b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label"), F.lit(True).alias("moved")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = cut(labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("next"), F.col("label").alias("was")))
        # A label is a node: take on the label that it has now.
        up = lower.select(F.col("node").alias("root"), F.col("next").alias("root_label"))
        label = F.least("next", "root_label")
        step = cut(lower.join(up, lower["next"] == up["root"]).select("node", label.alias("label"), (label != F.col("was")).alias("moved")))
        discard(labels, lower)
        labels = step
        if not labels.filter("moved").take(1):
            discard(both)
            return labels
