"""Connected components of a links table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import materialize


HUB = 1000  # links of a node from which on it may be a hub
MOST_HUBS = 1_000_000  # hubs that are broadcast at most: with more links, a hub has more of them


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One contraction of ``n`` links: every node links its larger neighbours (or all its smaller ones and itself) to the least of
    its neighbourhood. Links are (u, v) with u > v; one shuffle by node, in which the links of hubs take no part."""
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hub = max(HUB, 2 * n // MOST_HUBS)
    degrees = edges.groupBy("u").agg(F.count("*").alias("c"), F.min("v").alias("low"))
    others, hubs = edges, None
    if (degrees.agg(F.max("c")).first()[0] or 0) > hub:
        # a hub's least neighbour is a minimum that is combined before the shuffle; its links stay where they are
        low = F.broadcast(materialize(degrees.filter(F.col("c") > hub).select("u", "low"), "hubs"))
        hubs = edges.join(low, "u").select("u", "v", F.least("u", "low").alias("m"))
        others = edges.join(low, "u", "left_anti")
    seen = others.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    if hubs is not None:
        seen = seen.unionByName(hubs)
    if large:
        return seen.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    ends = F.explode(F.array("v", "u"))
    return seen.select(ends.alias("u"), F.col("m").alias("v")).filter("u <> v")


def connected_components(edges: DataFrame, u: str, v: str, most: int = 60) -> DataFrame:
    """``node``, ``component`` (the least node) for every node with a link to another one.

    Every pass writes its links to the shared folder; passes go on until the
    links no longer change, when they are stars.
    """
    e = materialize(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u <> v").distinct(), "links")
    last = None
    for _ in range(most):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or not now[0]:
            break
        last = now
        # few links are written as few files
        e = materialize(_star(e, True, now[0]).distinct().coalesce(max(8, now[0] // 50_000)), "half-links")
        e = materialize(_star(e, False, now[0]).distinct().coalesce(max(8, now[0] // 50_000)), "links")
    else:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
