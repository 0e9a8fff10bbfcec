"""Connected components of a table of links, by the smallest node each node can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(links: DataFrame, written, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of `links`: component is the smallest node it is linked with, over any number of links.

    Each round gives a node the smallest label among its own, its neighbours' and that of the node its label names, until no
    label changes; labels jump, so a chain of n links takes about log n rounds. Each round is one aggregation and two joins of
    stored tables (`written`): no node's neighbours are ever gathered. Links with a null end count for nothing; loops, repeated
    links and both directions are allowed; no links give an empty result.
    """
    some = links.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    both = written(some.union(some.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels")
    while True:
        reach = both.join(labels, both["b"] == labels["node"]).select(F.col("a").alias("node"), "component")
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("further"))
        own = labels.join(jump, labels["component"] == jump["via"]).select("node", F.col("further").alias("component"))
        lowest = reach.union(own).groupBy("node").agg(F.min("component").alias("component"))
        before = labels.select("node", F.col("component").alias("old"))
        after = written(lowest.join(before, "node").select("node", "component", (F.col("component") != F.col("old")).alias("changed")), "labels")
        labels = after.select("node", "component")
        if not after.filter("changed").take(1):
            return labels
