"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairline.llm import common
from pairline.llm.common import SALTS, cut, drop


def _least(edges: DataFrame, small: bool) -> DataFrame:
    """edges (a, b) with m, the smallest b of all edges of a; the edges of one a are never brought into one task."""
    if small:
        return edges.join(F.broadcast(edges.groupBy("a").agg(F.min("b").alias("m"))), "a")
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("m"))
    whole = parts.groupBy("a").agg(F.min("m").alias("m"))
    return salted.join(parts.select("a", "salt").join(whole, "a"), ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    """Link each neighbour above u with the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _least(both, small).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    """Link u and each neighbour below u with the smallest of these."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b")
    return _least(down, small).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Count and an order-free checksum: equal from one round to the next when nothing moves."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of edges (a, b), component being the smallest node reachable.

    Null ends and loops are left out; an edge may stand in either direction and repeatedly.
    """
    now = cut(edges.select("a", "b").where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while True:
        small = mark[0] <= common.BROADCAST_ROWS  # edges do not become more from round to round
        after = cut(_small_star(_large_star(now, small), small), "edges")
        drop(now)
        now, last = after, mark
        mark = _mark(now)
        if mark == last:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
