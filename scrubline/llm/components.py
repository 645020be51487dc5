"""Connected components of a graph of links, by joins and minima that are written between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import stored


def _signature(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root (the smallest node reachable) of every node of ``links`` (a, b: two longs).

    In each round every node hands the smallest of its neighbours to its larger
    neighbours, then to its smaller ones, until all are stars; links never grow in
    number, and rounds grow with the logarithm of the longest path. Neighbours are never
    gathered: a node with many costs a minimum and rows of a join, which Spark splits
    where they are skewed. Each round is written to the shared folder.
    """
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = _signature(now)
    for _ in range(rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
