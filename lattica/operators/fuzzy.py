"""Fuzzy joins by blocks: exact keys bring candidates together, a similarity decides, the best few of each row stay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blocked_join(left: DataFrame, right: DataFrame, block: Callable[[Column], Column], similarity: Callable[[Column, Column], Column], radius: int, least: float, keep: int, extra: list[str] | None = None) -> DataFrame:
    """(term, match, similarity, rank) of distinct terms: same block, lengths at most ``radius`` apart, similarity of ``least`` or more.

    The right side is listed under each length it may match, so the join is an equality; the ``keep`` best stay, ties by match.
    """
    extra = extra or []
    a = left.select("term", *extra).distinct().withColumns({"block": block(F.col("term")), "length": F.char_length("term")})
    near = F.explode(F.sequence(F.char_length("match") - radius, F.char_length("match") + radius))
    b = right.select(F.col("term").alias("match"), *extra).distinct().select("match", *extra, block(F.col("match")).alias("block"), near.alias("length"))
    pairs = a.join(b, ["block", "length", *extra]).filter("term <> match").select("term", "match", *extra, similarity(F.col("term"), F.col("match")).alias("similarity"))
    order = Window.partitionBy("term", *extra).orderBy(F.desc("similarity"), "match")
    return pairs.filter(F.col("similarity") >= least).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def phrase_matches(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, phrase, places): phrases (arrays of words) found as neighbouring tokens of (id, toks), through windows of the lengths that occur."""
    lengths = [r[0] for r in phrases.select(F.size("words").alias("n")).filter("n > 0").distinct().collect()]  # few different lengths

    def grams_of(n: int) -> DataFrame:
        at = F.sequence(F.lit(1), F.size("toks") - n + 1)
        return docs.filter(F.size("toks") >= n).select("id", F.explode(F.transform(at, lambda i: F.array_join(F.slice(F.col("toks"), i, n), " "))).alias("phrase"))

    out = None
    for n in sorted(lengths):
        known = phrases.filter(F.size("words") == n).select(F.array_join("words", " ").alias("phrase")).distinct()
        found = grams_of(n).join(known, "phrase").groupBy("id", "phrase").agg(F.count(F.lit(1)).alias("places"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.select("id", F.lit("").alias("phrase"), F.lit(0).cast("long").alias("places")).filter("false")
