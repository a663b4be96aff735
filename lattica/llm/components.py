"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import materialize


def _small_rooted(pairs: DataFrame) -> DataFrame:
    """(node, root) with the larger value first, once each."""
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: long) to (node, root): root is the smallest node reachable. Nodes without edges do not appear.

    Each round hangs every node's larger neighbours on its smallest neighbour, then every node on the smallest of its smaller
    ones, and is written to the shared folder. It ends when a round changes nothing; rounds grow as the square of the logarithm
    of the number of nodes at most. Minima are aggregated before they are shuffled; the joins by node have one row a node on one side,
    so that adaptive execution can split the other where a node has very many neighbours.
    """
    now = materialize(_small_rooted(edges), "edges")
    while True:
        before = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = materialize(_small_rooted(large), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), "low")
        small = large.join(least, F.col("a") == F.col("node")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        small = small.unionByName(least.select(F.col("node").alias("a"), F.col("low").alias("b")))
        now = materialize(_small_rooted(small), "small-star")
        if now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
