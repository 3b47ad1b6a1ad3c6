"""Connected components of a table of links, by alternating large-star and small-star rounds.

Every round is a grouping and a join on node ids; nothing is gathered per node, so a hub with millions of
links is aggregated before the shuffle and split by the engine's skew handling in the join. Rounds end when
the links no longer change; their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """edges: a < b. Links of each node (large: to larger nodes; else to smaller ones) move to its least neighbour."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = written(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", n)
    moved = sides.join(least, "u")
    if large:
        new = moved.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        new = moved.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    out = written(new.filter("a < b").distinct(), "links", n)
    dropped(least)
    return out


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """edges (a, b) to (node, component): the smallest node that each linked node can reach. Self-links and repeats are ignored."""
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links", rows)
    before = _state(now)
    while before[0]:
        big = _star(now, True, 2 * before[0])
        new = _star(big, False, 2 * before[0])
        dropped(now, big)
        # no link moved: every link already leads to the least node of its component
        after = _state(new)
        now = new
        if after == before:
            break
        before = after
    found = now.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")
    return written(found, "components", before[0])
