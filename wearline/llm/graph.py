"""Connected components of a list of links, by Spark joins.

Each round gives a node the smallest label among its own, its neighbours' and
its label's label (pointer jumping), so that stars close in two rounds and
chains in a logarithm of their length.  Neighbour minima are aggregated before
the shuffle; a hub's links are split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b); ``comp`` is the smallest node reachable."""
    both = store(
        links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links"
    )
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_b")).select("node", F.least("node", "_b").alias("comp"))
    labels = store(labels, "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("_near"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("_jump"))
        new = labels.join(near, "node", "left").join(jump, "comp", "left").select(
            "node", F.col("comp").alias("_old"), F.least("comp", "_near", "_jump").alias("comp")
        )
        new = store(new, "labels")
        if new.where("comp != _old").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")
