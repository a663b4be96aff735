"""Interval algebra over events: every event is an interval of ten minutes of its user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.text import clock
from lattica.operators import intervals as I
from lattica.plans.registry import query, table

LENGTH, GAP, BUCKET = 600.0, 60.0, 3600.0
_E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS t FROM events)"


def _merged(name: str, where: str = "true") -> str:
    return (
        f"{name}o AS (SELECT user_id, t AS s, t + 600 AS f, max(t + 600) OVER (PARTITION BY user_id ORDER BY t, t + 600 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM e WHERE {where}), "
        f"{name}i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 60 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS island FROM {name}o), "
        f"{name} AS (SELECT user_id, min(s) AS s, max(f) AS f, count(*) AS members FROM {name}i GROUP BY user_id, island)"
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", at.alias("start"), (at + LENGTH).alias("end"))


@query("interval_merge", f"WITH {_E}, {_merged('m')} SELECT user_id, round(s, 3) AS start, round(f, 3) AS \"end\", members FROM m")
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.merge(spans(spark, sf_dir), ["user_id"], gap=GAP)
    return rows.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "members")


@query(
    "interval_intersect",
    f"""WITH {_E}, {_merged("a", "event_type < 'm'")}, {_merged("b", "event_type >= 'm'")}
    SELECT a.user_id, round(greatest(a.s, b.s), 3) AS start, round(least(a.f, b.f), 3) AS "end" FROM a JOIN b ON a.user_id = b.user_id AND a.s < b.f AND b.s < a.f""",
)
def interval_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    a, b = (I.merge(rows.filter(x), ["user_id"], gap=GAP) for x in ("event_type < 'm'", "event_type >= 'm'"))
    out = I.intersect(a, b, ["user_id"], BUCKET)
    return out.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("coverage_ratio", f"WITH {_E}, {_merged('m')}, r AS (SELECT max(t) - min(t) + 600 AS d FROM e) SELECT user_id, round(least(1.0, sum(f - s) / any_value(d)), 6) AS ratio FROM m, r GROUP BY user_id")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    span = rows.agg((F.max("end") - F.min("start")).alias("d"))  # one row
    merged = I.merge(rows, ["user_id"], gap=GAP).join(F.broadcast(span))
    return I.coverage(merged, ["user_id"], F.first("d")).withColumn("ratio", F.round("ratio", 6))


@query(
    "asof_best_overlap",
    f"""WITH {_E}, a AS (SELECT * FROM e WHERE event_type < 'm'), b AS (SELECT * FROM e WHERE event_type >= 'm'),
    p AS (SELECT a.user_id, a.event_id, b.event_id AS best_id, greatest(0, least(a.t, b.t) + 600 - greatest(a.t, b.t)) / 600 AS sim FROM a JOIN b ON a.user_id = b.user_id AND abs(a.t - b.t) < 600)
    SELECT user_id, event_id, best_id, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY round(sim, 9) DESC, best_id) AS r FROM p WHERE sim >= 0.25) WHERE r = 1""",
)
def asof_best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir).select("user_id", "event_type", "event_id", "start", "end")
    a, b = (rows.filter(x).drop("event_type") for x in ("event_type < 'm'", "event_type >= 'm'"))
    out = I.best_overlap(a, b, ["user_id"], ["l_event_id"], ["r_event_id"], BUCKET, 0.25)
    return out.select("user_id", F.col("l_event_id").alias("event_id"), F.col("r_event_id").alias("best_id"), F.round("similarity", 6).alias("similarity"))


@query("point_in_interval", f"WITH {_E}, {_merged('m')} SELECT e.event_id, round(m.s, 3) AS start FROM e JOIN m ON e.user_id = m.user_id AND e.t BETWEEN m.s AND m.f")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    points = rows.select("event_id", "user_id", F.col("start").alias("t"))
    return I.contained(points, I.merge(rows, ["user_id"], gap=GAP), ["user_id"], "t", BUCKET).select("event_id", F.round("span_start", 3).alias("start"))


@query(
    "session_clusters",
    f"""WITH {_E}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w > 1800 THEN 1 ELSE 0 END AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
    s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
    c AS (SELECT user_id, session, event_type, count(*) AS n FROM s GROUP BY ALL), m AS (SELECT user_id, session, arg_min(event_type, (-n, event_type)) AS kind FROM c GROUP BY ALL)
    SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, round(median(value), 6) AS median_value, any_value(kind) AS most_frequent FROM s JOIN m USING (user_id, session) GROUP BY user_id, session""",
)
def session_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.sessions(spans(spark, sf_dir), ["user_id"], "start", 1800.0, ["event_id"])
    kinds = rows.groupBy("user_id", "session", "event_type").count().groupBy("user_id", "session").agg(F.min(F.struct((-F.col("count")).alias("n"), "event_type")).alias("k"))
    out = rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.median("value"), 6).alias("median_value")).join(kinds, ["user_id", "session"])
    return out.select("user_id", "session", "n_events", "median_value", F.col("k.event_type").alias("most_frequent"))


@query(
    "subtitle_clock",
    """WITH x AS (SELECT event_id, CAST(round(value * 1000) AS BIGINT) AS ms FROM events WHERE value >= 0)
    SELECT event_id, printf('%02d:%02d:%02d,%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS stamp FROM x""",
)
def subtitle_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value >= 0").select("event_id", clock(F.col("value")).alias("stamp"))


@query(
    "session_window_counts",
    f"""WITH {_E}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 1800 THEN 1 ELSE 0 END AS n FROM e),
    s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, round(min(t), 3) AS start, count(*) AS n FROM s GROUP BY user_id, session""",
)
def session_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.round(F.unix_micros("w.start") / 1e6, 3).alias("start"), "n")


@query("rollup_revenue", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, grouping(l_returnflag, l_linestatus) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).alias("revenue"), F.grouping_id().cast("long").alias("level"))


@query("priority_overlaps")
def priority_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir).select("user_id", "event_id", "start", "end", F.col("value").alias("priority"))
    return I.resolve_by_priority(rows, "user_id").select("user_id", "event_id", "start", "end")
