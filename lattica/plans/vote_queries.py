"""Votes over events: an hour of a user is a slot, the event type a candidate, the user number modulo 3 its family."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import claims, grounding, voting
from lattica.plans.registry import query, table
from lattica.sources import readers

_TOKS = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')"
_V = """v AS (SELECT CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS slot, event_type AS candidate, user_id % 3 AS family, value AS confidence FROM events),
b AS (SELECT slot, candidate, family, max(confidence) AS best, count(*) AS n FROM v GROUP BY ALL),
s AS (SELECT slot, candidate, sum(n) AS votes, count(*) AS families, avg(best) AS confidence, 1.0 * sum(n) + 0.35 * count(*) + 0.5 * avg(best) AS score FROM b GROUP BY ALL)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 86400).cast("long")
    return table(spark, sf_dir, "events").select(day.alias("slot"), F.col("event_type").alias("candidate"), (F.col("user_id") % 3).alias("family"), F.col("value").alias("confidence"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.votes(observations(spark, sf_dir), ["slot"])


@query("family_vote", f"WITH {_V} SELECT slot, candidate, CAST(votes AS BIGINT) AS votes, families, round(confidence, 4) AS confidence, round(CAST(score AS DOUBLE), 4) AS score FROM s")
def family_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("confidence", "score")})


@query(
    "candidate_margin",
    f"""WITH {_V}, r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS runner_up FROM s WINDOW w AS (PARTITION BY slot ORDER BY score DESC, candidate))
    SELECT slot, candidate, families, round(CAST(score - coalesce(runner_up, 0) AS DOUBLE), 4) AS margin,
    CASE WHEN families >= 3 AND score - coalesce(runner_up, 0) >= -0.25 THEN 'ACCEPT' WHEN families >= 2 THEN 'REVIEW' ELSE 'KEEP_SOURCE' END AS verdict FROM r WHERE rank = 1""",
)
def candidate_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.margins(_scored(spark, sf_dir), ["slot"]).select("slot", "candidate", "families", F.round("margin", 4).alias("margin"), "verdict")


@query(
    "neighbour_support",
    f"""WITH {_V} SELECT s.slot, s.candidate, count(o.slot) AS neighbours, round(CAST(any_value(s.score) + 1.45 * count(o.slot) AS DOUBLE), 4) AS supported
    FROM s LEFT JOIN s o ON o.candidate = s.candidate AND abs(o.slot - s.slot) = 1 GROUP BY s.slot, s.candidate""",
)
def neighbour_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.neighbour_support(_scored(spark, sf_dir), [], "slot").select("slot", "candidate", "neighbours", F.round("supported", 4).alias("supported"))


@query(
    "emission_scores",
    f"""WITH {_V}, x AS (SELECT slot, candidate, families, votes, confidence, (SELECT count(*) FROM s o WHERE o.slot = s.slot) AS n FROM s)
    SELECT slot, candidate, round(CAST(2.20 * families + 0.16 * votes + 0.42 * confidence / 1000 + 0.11 * ln(1 + n) AS DOUBLE), 4) AS emission FROM x""",
)
def emission_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    sizes = rows.groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
    zero, families = F.lit(0), F.col("families")
    score = voting.emission(families, families, families, F.col("votes"), F.col("confidence") / 1000, zero, F.col("n"), F.lit(True))
    return rows.join(sizes, "slot").select("slot", "candidate", F.round(score, 4).alias("emission"))


@query("verdict_histogram", """WITH x AS (SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'REJECT' WHEN l.quality = 0 THEN 'REVIEW' WHEN l.quality = 1 AND d.n_chars >= 200 THEN 'ACCEPT' ELSE 'KEEP_SOURCE' END AS verdict, d.n_chars
    FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT verdict, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM x GROUP BY verdict""")
def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    checks = {"REJECT": F.col("toxic") == 1, "REVIEW": F.col("quality") == 0, "ACCEPT": (F.col("quality") == 1) & (F.col("n_chars") >= 200)}
    return rows.groupBy(F.coalesce(grounding.first_reason(checks), F.lit("KEEP_SOURCE")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@query("invariant_report", f"WITH {_V} SELECT CAST((SELECT count(*) FROM events) AS BIGINT) AS n_observations, CAST((SELECT sum(votes) FROM s) AS BIGINT) AS n_voted, 0 AS n_extra, 0 AS n_missing")
def invariant_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, scored = observations(spark, sf_dir), _scored(spark, sf_dir)
    a, b = rows.select("slot", "candidate").distinct(), scored.select("slot", "candidate")
    counts = rows.agg(F.count(F.lit(1)).alias("n_observations")).join(scored.agg(F.sum("votes").alias("n_voted")))  # one row each
    return counts.join(grounding.same_rows(a, b))


@query(
    "family_jaccard",
    rf"""WITH e AS (SELECT DISTINCT lang AS grp, source AS family, unnest({_TOKS}) AS tok FROM documents), n AS (SELECT grp, family, count(*) AS n FROM e GROUP BY ALL),
    c AS (SELECT a.grp, a.family AS family_a, b.family AS family_b, count(*) AS common FROM e a JOIN e b ON a.grp = b.grp AND a.tok = b.tok AND a.family < b.family GROUP BY ALL)
    SELECT c.*, round(common / (x.n + y.n - common), 6) AS jaccard FROM c JOIN n x ON x.grp = c.grp AND x.family = family_a JOIN n y ON y.grp = c.grp AND y.family = family_b""",
)
def family_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("grp"), F.col("source").alias("family"), F.explode(T.tokens(F.col("text"))).alias("tok"))
    return voting.family_jaccard(rows)


_SIDES = rf"c AS (SELECT conv_id, unnest({_TOKS}) AS tok FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, unnest({_TOKS}) AS tok FROM conversations WHERE role <> 'assistant')"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "conversations")
    words = lambda x: rows.filter(x).select("conv_id", F.explode(T.tokens(F.col("text"))).alias("tok"))
    return words("role = 'assistant'"), words("role <> 'assistant'")


@query("multiset_excess", f"WITH {_SIDES}, x AS (SELECT conv_id, tok, count(*) AS n FROM c GROUP BY ALL), y AS (SELECT conv_id, tok, count(*) AS n FROM u GROUP BY ALL) SELECT conv_id, tok, x.n - coalesce(y.n, 0) AS excess FROM x LEFT JOIN y USING (conv_id, tok) WHERE x.n > coalesce(y.n, 0)")
def multiset_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voting.multiset_excess(*_sides(spark, sf_dir), ["conv_id"])


@query("unsupported_tokens", f"WITH {_SIDES} SELECT conv_id, tok FROM c EXCEPT SELECT conv_id, tok FROM u")
def unsupported_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grounding.unsupported(*_sides(spark, sf_dir), ["conv_id"])


@query("common_tokens", f"WITH {_SIDES} SELECT conv_id, tok FROM c INTERSECT SELECT conv_id, tok FROM u")
def common_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sides(spark, sf_dir)
    return a.intersect(b)


@query(
    "token_context_window",
    rf"""WITH t AS (SELECT conv_id, turn, {_TOKS} AS w FROM conversations), e AS (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM t)
    SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, w[i] AS tok, array_to_string(w[greatest(1, i - 2) : i + 2], ' ') AS context FROM e""",
)
def token_context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))
    start = F.greatest(F.lit(0), F.col("pos") - 2)
    return rows.select("conv_id", "turn", "w", F.posexplode("w").alias("pos", "tok")).select("conv_id", "turn", "pos", "tok", F.array_join(F.slice("w", start + 1, F.col("pos") - start + 3), " ").alias("context"))


@query(
    "repeat_collapse",
    rf"""WITH t AS (SELECT conv_id, turn, {_TOKS} AS w FROM conversations), e AS (SELECT conv_id, turn, unnest(w) AS tok, unnest(range(len(w))) AS pos FROM t),
    k AS (SELECT *, lag(tok) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS before FROM e) SELECT conv_id, turn, string_agg(tok, ' ' ORDER BY pos) AS kept FROM k WHERE before IS NULL OR before <> tok GROUP BY ALL""",
)
def repeat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    return rows.select("conv_id", "turn", F.array_join(grounding.without_adjacent(F.col("w")), " ").alias("kept"))


@query(
    "stitch_coalesce",
    """SELECT conv_id, turn, coalesce(nullif(CASE WHEN role = 'assistant' THEN trim(text) END, ''), lag(trim(text)) OVER (PARTITION BY conv_id ORDER BY turn), '') AS stitched FROM conversations""",
)
def stitch_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.trim("text").alias("said"), (F.col("role") == "assistant").alias("own"))
    rows = claims.before(rows, ["conv_id"], ["turn"], ["said"])
    return rows.select("conv_id", "turn", claims.first_text(F.when(F.col("own"), F.col("said")), F.col("before_said")).alias("stitched"))


@query("latest_result", "SELECT c_custkey, o_orderstatus, o_orderkey FROM (SELECT o_custkey AS c_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 WHEN 'F' THEN 3 ELSE 4 END, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_orderkey")
    return readers.latest_result(rows, "c_custkey", "o_orderstatus", ["P", "O", "F"], "o_orderkey")
