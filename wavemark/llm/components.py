"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Table


def _mark(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("h")).first()
    return r.n, r.h


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with a link: the smallest node reachable. Links are columns a and b, in any order.

    Each round joins the links with each node's smallest neighbour, so a node with very many links is split like any
    skewed join key, and writes the links it makes; nothing but a count and a checksum comes to the driver.
    """
    table = Table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(table.read())
    while True:
        links = table.read()
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # larger neighbours go to the lowest
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("n"), "m").unionByName(least.select(F.col("a").alias("n"), "m"))
        done = Table(small.where("n <> m").select(F.col("n").alias("a"), F.col("m").alias("b")).distinct(), "links")
        table.drop()
        table, (before, mark) = done, (mark, _mark(done.read()))
        if mark == before:
            break
    stars = table.read()
    return stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
