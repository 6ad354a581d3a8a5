"""Connected components of a table of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def fewer_links(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Links that join the same nodes, where each of many nodes a has links to a bounded number of nodes b: a is tied to the smallest of its own, and they to it.

    Nodes that share their b, as all of a large group do, then have one link each, and those among the b are the same for all."""
    own = links.groupBy(F.col(a).alias("a")).agg(F.collect_set(b).alias("every"), F.min(b).alias("b"))
    others = F.transform("every", lambda x: F.struct(x.alias("a"), F.col("b").alias("b")))
    both = F.concat(F.array(F.struct("a", "b")), others)
    return own.select(F.explode(both).alias("x")).select("x.a", "x.b").filter("a <> b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its smallest node) of every node that has a link.

    In each round a node takes the smallest label among its neighbours' and its own, and then the label of that label's node, so that paths
    halve; rounds end when no label changes."""
    both = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    edges = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("l")).select("node", F.least("node", "l").alias("label")))
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        seen = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("up"), F.col("label").alias("top"))
        moved = cut(seen.join(up, seen.label == up.up).select("node", "old", F.least("label", "top").alias("label")))
        if moved.filter("label < old").isEmpty():
            return moved.select("node", F.col("label").alias("component"))
        labels = moved.select("node", "label")
