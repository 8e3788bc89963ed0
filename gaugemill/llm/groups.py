"""Connected groups of links, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.session import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the smallest node it is connected with, ``comp``, for every node of ``edges`` (a, b).

    Alternates between tying the larger neighbours, and the smaller ones, of each node to its smallest neighbour until
    all links are stars. A node's neighbours are never gathered: a step is a minimum and a join on written tables, and a
    step's tables are removed once the next are written.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = stage(ordered, "component-links")
    while True:
        many = links.groupBy("a").count().where("count > 1").select("a")
        inner = links.select(F.col("b").alias("a")).join(links, "a", "left_semi")
        if many.unionByName(inner).isEmpty():
            break
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stage(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("least")), "component-least")
        # larger neighbours, to the smallest of all neighbours
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("least"))  # few neighbours of a node are smaller now
        before, links = links, stage(  # smaller neighbours, and the node, to the smallest of them
            large.join(lower, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(lower.select("a", F.col("least").alias("b"))).distinct(), "component-links")
        discard(before, least)
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("comp"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots)


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) of groups known so far, once ``links`` (a, b) connect them and further nodes.

    Only links between different groups are followed, as links of their names. What is given is removed.
    """
    if labels is None:
        known = stage(components(links), "component-labels")
        discard(links)
        return known
    named = links.select("a", "b")
    for x in "ab":
        named = named.join(labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")), x, "left")
    named = named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    moved = components(named)
    old = labels.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    known = stage(old.unionByName(moved.join(labels.select("node"), "node", "left_anti")), "component-labels")
    discard(labels, links)
    return known
