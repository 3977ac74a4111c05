"""Connected components of a table of links, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuskit.session import checkpointed


def roots(links: DataFrame) -> DataFrame:
    """(node, root) with the smallest node of every component, for nodes that are no root themselves.

    ``links`` has two long columns u, v; the order of a link, repeats and loops do not
    matter.  Every round points the neighbours of a node at their smallest one, first the
    larger neighbours, then the smaller ones, which ends after a logarithmic number of rounds.
    Neighbour lists are never gathered: the minimum is an aggregate, the links are joined to it.
    """
    high = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    edges = checkpointed(links.select(*high).filter("u > v").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = checkpointed(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        pulled = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = checkpointed(pulled.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
