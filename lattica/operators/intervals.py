"""Interval algebra and joins on time: merge, intersect, coverage, best overlap, containment and sessions.

Joins on overlap go by time buckets, so that only intervals of the same key and bucket meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Padding and join gap of the first and second review stage.
PADDING, JOIN_GAP, SECOND_PADDING, SECOND_JOIN_GAP, INTERSECTION_GAP = 1.15, 0.85, 0.65, 0.45, 0.05


def merge(df: DataFrame, keys: list[str], padding: float = 0.0, gap: float = 0.0, duration: Column | None = None, reasons: str | None = None) -> DataFrame:
    """Padded, clamped, non-empty intervals (start, end) of each key, joined where one begins at most ``gap`` after the furthest end so far."""
    start = F.greatest(F.lit(0.0), F.col("start") - padding) if padding else F.col("start")
    end = F.col("end") + padding if padding else F.col("end")
    rows = df.withColumns({"start": start, "end": end if duration is None else F.least(end, duration)}).filter("end > start")
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(reach.isNull() | (F.col("start") > reach + gap), 1).otherwise(0)).over(order)
    found = [F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("members")]
    if reasons:
        found.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(reasons)))).alias(reasons))
    return rows.withColumn("__island", island).groupBy(*keys, "__island").agg(*found).drop("__island")


def _buckets(start: Column, end: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs (a as l_start, l_end; b as r_start, r_end; other columns prefixed alike) of a key that share time, each pair once."""
    left = a.select(*keys, *(F.col(c).alias(f"l_{c}") for c in a.columns if c not in keys)).withColumn("__bucket", _buckets(F.col("l_start"), F.col("l_end"), width))
    right = b.select(*keys, *(F.col(c).alias(f"r_{c}") for c in b.columns if c not in keys)).withColumn("__bucket", _buckets(F.col("r_start"), F.col("r_end"), width))
    first = F.floor(F.greatest("l_start", "r_start") / width) == F.col("__bucket")
    return left.join(right, [*keys, "__bucket"]).filter(first).filter("l_start < r_end AND r_start < l_end").drop("__bucket")


def intersect(a: DataFrame, b: DataFrame, keys: list[str], width: float, gap: float = INTERSECTION_GAP) -> DataFrame:
    """Merged parts that both sides cover."""
    both = overlaps(a.select(*keys, "start", "end"), b.select(*keys, "start", "end"), keys, width)
    return merge(both.select(*keys, F.greatest("l_start", "r_start").alias("start"), F.least("l_end", "r_end").alias("end")), keys, gap=gap)


def coverage(merged: DataFrame, keys: list[str], duration: Column) -> DataFrame:
    """Share of ``duration`` (an aggregate) that the intervals of a key cover, 1 at most."""
    return merged.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(F.col("end") - F.col("start")) / duration).alias("ratio"))


def temporal_similarity(pair: DataFrame) -> Column:
    shared = F.greatest(F.lit(0.0), F.least("l_end", "r_end") - F.greatest("l_start", "r_start"))
    return shared / F.greatest(F.col("l_end") - F.col("l_start"), F.col("r_end") - F.col("r_start"), F.lit(0.001))


def best_overlap(a: DataFrame, b: DataFrame, keys: list[str], own: list[str], tie: list[str], width: float, least: float = 0.55) -> DataFrame:
    """Of each left interval (known by the ``own`` columns) the right one of highest temporal similarity, if that is ``least`` or more; ties by ``tie``."""
    pairs = overlaps(a, b, keys, width)
    pairs = pairs.withColumn("similarity", temporal_similarity(pairs)).filter(F.col("similarity") >= least)
    order = Window.partitionBy(*keys, *own).orderBy(F.desc("similarity"), *tie)
    return pairs.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def contained(points: DataFrame, spans: DataFrame, keys: list[str], at: str, width: float, before: float = 0.0, after: float = 0.0) -> DataFrame:
    """Points with a span of their key that holds them (``start - before <= at <= end + after``); a row for each such span."""
    right = spans.select(*keys, (F.col("start") - before).alias("span_start"), (F.col("end") + after).alias("span_end"))
    right = right.withColumn("__bucket", _buckets(F.col("span_start"), F.col("span_end"), width))
    left = points.withColumn("__bucket", F.floor(F.col(at) / width))
    return left.join(right, [*keys, "__bucket"]).filter(F.col(at).between(F.col("span_start"), F.col("span_end"))).drop("__bucket")


def sessions(df: DataFrame, keys: list[str], at: str, gap: float, order: list[str]) -> DataFrame:
    """``df`` with ``session``: 0, 1, ... within a key, new where more than ``gap`` lies between neighbours."""
    w = Window.partitionBy(*keys).orderBy(at, *order)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).drop("__new")


def resolve_by_priority(df: DataFrame, key: str) -> DataFrame:
    """Greedy choice of (start, end, priority) rows of a key: highest priority first, then earliest; what overlaps a chosen row goes."""
    schema = df.schema

    def choose(pdf):  # noqa: ANN001, ANN202
        from bisect import bisect_left

        order = pdf.sort_values(["priority", "start", "end"], ascending=[False, True, True], kind="stable")
        starts: list[float] = []  # of the chosen, which never overlap, so that only the neighbours of a row can meet it
        ends: list[float] = []
        keep = []
        for i, start, end in zip(order.index, order["start"], order["end"], strict=True):
            at = bisect_left(starts, start)
            if (at == 0 or ends[at - 1] <= start) and (at == len(starts) or starts[at] >= end):
                starts.insert(at, start)
                ends.insert(at, end)
                keep.append(i)
        return pdf.loc[sorted(keep)]

    return df.groupBy(key).applyInPandas(choose, schema)
