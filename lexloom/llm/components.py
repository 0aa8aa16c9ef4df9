"""Connected components of a large undirected graph by alternating large-star and small-star steps (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import drop_stored, stored


def _toward_min(pairs: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    """pairs(u, v) with m, the least of u and its v. The least is written first, so the join deals both sides anew and
    a hub with very many pairs can be split."""
    least = stored(pairs.groupBy(F.col("u").alias("hub")).agg(F.min("v").alias("m")), "star-min")
    scratch.append(least)
    return pairs.join(least, F.col("u") == F.col("hub")).select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _toward_min(both, scratch).where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, scratch: list[DataFrame]) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    starred = _toward_min(down, scratch)
    moved = starred.where(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(starred.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).head())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge, with root the least node of its component.

    edges(a long, b long). Each round is two star steps written to the shared folder; rounds grow with the logarithm of
    the component size. The rounds end when the edge set, by count and hash sum, no longer changes.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges")
    seen = _signature(now)
    while seen[0]:
        scratch: list[DataFrame] = []
        large = stored(_large_star(now, scratch), "large-star")
        small = stored(_small_star(large, scratch), "small-star")
        for old in (now, large, *scratch):
            drop_stored(old)
        now, before = small, seen
        seen = _signature(now)
        if seen == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
