"""Connected components of a link table, by alternating star contractions.

Each round is two grouped minima and two joins over the links that are left; nothing is gathered
on the driver but the number of links. Rounds grow with the logarithm of the longest chain. Every
round is written to the shared checkpoint folder, so lineage stays short and lost executors cost
one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def star(links: DataFrame, large: bool) -> DataFrame:
    """One contraction: the neighbours of u (the larger ones, or the others and u) point to the
    smallest of u and its neighbours."""
    if large:
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    joined = both.join(low, "u")
    moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("low").alias("v")) if large else joined.where(F.col("v") != F.col("low")).select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.where(F.col("u") != F.col("low")).select("u", F.col("low").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with a link; component is its smallest reachable node.

    ``links`` has long columns u and v. Self links and repeats are ignored.
    """
    now = cut(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = summary(now)
    for _ in range(most_rounds):
        if mark[0] == 0:
            break
        now = cut(star(star(now, True), False))
        was, mark = mark, summary(now)
        if was == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))


def summary(links: DataFrame) -> tuple:
    """Size and an order-free checksum: equal before and after a round only if nothing moved."""
    row = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
    return tuple(row)
