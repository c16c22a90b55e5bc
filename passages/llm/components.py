"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is two aggregations and a join; links stay in tables (written between rounds), their number never
grows, a hub's links are aggregated before the shuffle, and where they meet its least neighbour they are dealt over
several tasks. Rounds grow with the logarithm of the size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passages.llm.common import removed, spread_join, written


def oriented(links: DataFrame) -> DataFrame:
    """Distinct links (u, v) with u > v."""
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return spread_join(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = spread_join(links, least, ["u"])
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) of longs -> (node, component): the least node of each component, for nodes with links."""
    now = written(oriented(links), "links")
    before = None
    while True:
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sums == before or not sums["n"]:
            break
        before = sums
        last, now = now, written(small_star(large_star(now)), "links")
        removed(last)
    # stable: every node points at its component's least node
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """A subset of the links (u, v) that connects what they connect."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    kept = []
    for x, y in zip(u.tolist(), v.tolist()):
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            kept.append((x, y))
    return kept
