"""Connected components by alternating stars, every step a join and a minimum over edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of ``edges`` (a, b); component is the smallest node reachable.

    Each round points every node to its smallest known neighbour and then joins the neighbours'
    own targets, so a chain of n nodes takes about log n rounds; the edges stay linear in number.
    """
    scratch = Scratch(edges.sparkSession, "components")
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    pairs = scratch.write(pairs, "round-0")
    before = None
    for step in count(1):
        # Large star: the larger neighbours of a node point to its smallest neighbour.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(least.select("a", F.col("m").alias("b")))
        pairs = scratch.write(small.distinct(), f"round-{step}")
        scratch.drop(f"round-{step - 1}")
        state = pairs.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    found = pairs.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
    roots = pairs.select(F.col("b").alias("node")).distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(roots.select("node", F.col("node").alias("component")))
