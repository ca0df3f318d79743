"""Connected components by alternating large-star and small-star steps, each a grouped minimum and a join; labels never leave the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long; loops and repeats allowed). Returns node, component (its smallest node) for every node that isn't its component's smallest.

    The steps keep connectivity and end with stars; nulls are dropped; no edges give no rows. Each step's edges are written to the shared
    folder, so a lost executor costs one step at most, and deleted when the next step's are written.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    mark = None
    while (now := e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()) != mark and now[0]:
        mark = now
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        roots = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(roots, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, e = e, cut(small.union(roots.select("a", F.col("m").alias("b"))).distinct())
        drop(before, large)
    return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
