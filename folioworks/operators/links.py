"""Groups of rows that links tie together, over any number of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import kept

#: A place is a hub if it has so many links and this share of all of them; so there are at most 1 / HUB_SHARE hubs.
HUB_LINKS, HUB_SHARE = 500, 0.005


def _nearest(edges: DataFrame, of: DataFrame, n: int) -> DataFrame:
    """(u, v, m) for every edge (u, v): m is the least v among u's edges in `of`, which has n rows and all u; minima of hubs are broadcast."""
    least = of.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links"))
    hub = F.col("links") > max(HUB_LINKS, int(HUB_SHARE * n))
    few, many = F.broadcast(least.where(hub).drop("links")), least.where(~hub).drop("links")
    return edges.join(few, "u").union(edges.join(F.broadcast(least.where(hub).select("u")), "u", "left_anti").join(many, "u"))


def linked_groups(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b) of two different ones: root is the least node of those that it is linked to.

    Rounds of large and small stars: a node's greater neighbours, then its lesser ones,
    are linked to the least of all, until nothing changes.
    """
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen, n = None, now.count()
    while n:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = kept(_nearest(both.where("v > u"), both, 2 * n).select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), "stars")
        small = _nearest(large, large, n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = kept(small.where("u <> v").distinct(), "links")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, n = mark, mark[0]
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
