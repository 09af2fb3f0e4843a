"""Connected components of a list of links between longs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, drop


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root (the smallest node it reaches) of every node that has a link, by alternating large and small stars.

    Each round ties a node's larger neighbours, then its smaller ones, to the smallest of them; rounds grow as the
    logarithm of the longest path, and links never grow in number. Each round is cut, one count comes to the driver, and the round's files go.
    A node's neighbours meet as rows of a join and a minimum, never as one list.
    """
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))  # cut, so that AQE may split the join
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large)
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = cut(small)
        changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        drop(edges, least, large)
        edges = after
        if not changed:
            break
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
