"""Connected components of a graph of links, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texweave.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """``node, class`` for every node of ``links`` (columns ``a, b``); the class is its smallest node.

    Minimum labels travel along links and then along labels (pointer jumping),
    so the rounds grow with the logarithm of the longest path. Every round is
    cut and nothing but a count reaches the driver. Repeated links and links
    of a node with itself do no harm; null ends must be filtered before.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("class")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("class").alias("low"))
        spread = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("class").alias("was"), F.least("class", "low").alias("class"))
        above = spread.select(F.col("node").alias("up"), F.col("class").alias("up_class"))
        jumped = spread.join(above, spread["class"] == above["up"], "left").select("node", "was", F.least("class", "up_class").alias("class"))
        moved = cut(jumped)
        labels = moved.select("node", "class")
        if moved.filter(F.col("was") != F.col("class")).isEmpty():
            return labels
