"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id that a link names; the component is its least id.

    ``links`` has columns a and b (long). Large-star and small-star steps alternate
    until no link changes, which a number of rounds that grows with the logarithm of
    the links settles; each round is a written table, so lineage stays short, and only
    a count and a checksum of the links go to the driver.
    """
    ordered = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = scratch.save(ordered.distinct(), "links")
    seen = None
    while True:
        # Large star: larger neighbours of each node go to its least neighbour.
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # Small star: smaller neighbours of each node, and itself, go to the least of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(small, "links")
        mark = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
        scratch.drop(now)
        now = after
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
