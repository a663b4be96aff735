"""Doubt, sensitivity, gates, priors, locks and regions, over order lines, events and conversations that stand in for slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import names as N
from lattica.operators import slots as O
from lattica.operators import voting
from lattica.plans.interval_queries import BUCKET, _E, spans
from lattica.plans.name_queries import _SAID, said, sim
from lattica.plans.registry import query, table
from lattica.plans.vote_queries import _V, _scored

# Measures of a segment, from an order line.
_MEASURES = {
    "avg_logprob": "-l_discount * 10 - 0.3", "compression_ratio": "1.5 + l_tax * 10", "no_speech_prob": "l_discount * 5", "mean_probability": "1 - l_quantity / 100", "similarity": "1 - l_tax * 5",
    "word_probability": "1 - l_quantity / 80", "word_similarity": "1 - l_discount * 4", "critical": "l_returnflag = 'R'", "foreign": "l_linenumber = 7", "counterpart": "CASE WHEN l_linenumber < 6 THEN 1 - l_tax * 2 END",
}


def _doubt(stage: int) -> str:
    limit = O.DOUBT[stage]
    over = ("compression_ratio", "no_speech_prob")
    each = [f"CASE WHEN {name} {'>' if name in over else '<'} {value} THEN '{name}' END" for name, value in limit.items()] + ["CASE WHEN critical THEN 'critical' END"]
    if stage == 0:
        each += ["CASE WHEN \"foreign\" THEN 'foreign' END", "CASE WHEN coalesce(counterpart < 0.45, true) THEN 'missing' END"]
    found = f"array_to_string(list_filter([{', '.join(each)}], lambda x: x IS NOT NULL), ',')"
    return found if stage == 0 else f"CASE WHEN \"foreign\" THEN 'foreign' WHEN coalesce(counterpart < 0.45, true) THEN 'missing' ELSE {found} END"


def _sql_doubts(stage: int) -> str:
    measures = ", ".join(f'round({e}, 9) AS "{n}"' if n not in ("critical", "foreign") else f'{e} AS "{n}"' for n, e in _MEASURES.items())
    return f"WITH m AS (SELECT l_orderkey, l_linenumber, {measures} FROM lineitem) SELECT reasons, count(*) AS n FROM (SELECT {_doubt(stage)} AS reasons FROM m) GROUP BY reasons"


def _doubts(spark: SparkSession, sf_dir: str, stage: int) -> DataFrame:
    measured = [F.expr(e).alias(n) if n in ("critical", "foreign") else F.round(F.expr(e), 9).alias(n) for n, e in _MEASURES.items()]
    rows = table(spark, sf_dir, "lineitem").select(*measured)
    return rows.groupBy(F.array_join(O.doubts(stage), ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query("doubt_first_stage", _sql_doubts(0))
def doubt_first_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubts(spark, sf_dir, 0)


@query("doubt_second_stage", _sql_doubts(1))
def doubt_second_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubts(spark, sf_dir, 1)


@query(
    "sensitive_tokens",
    f"""WITH {_SAID}, k AS (SELECT *, bool_or(tok IN ('not', 'no', 'ni', 'pas')) OVER w AS a, bool_or(length(tok) >= 14) OVER w AS b FROM w WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, array_to_string(list_filter([CASE WHEN a THEN 'negation' END, CASE WHEN b THEN 'long' END], lambda x: x IS NOT NULL), ',') AS sensitive FROM k WHERE a OR b""",
)
def sensitive_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"negation": F.col("tok").isin("not", "no", "ni", "pas"), "long": F.char_length("tok") >= 14}
    rows = O.sensitivity(said(spark, sf_dir).drop("role"), ["conv_id", "turn"], kinds).filter(F.size("sensitive") > 0)
    return rows.select("conv_id", "turn", "pos", F.array_join("sensitive", ",").alias("sensitive"))


@query(
    "observation_quality",
    """SELECT l_orderkey, l_linenumber, round(CAST(1 - l_quantity / 100 + 0.18 * (greatest(-2, least(0, -l_discount * 30)) + 2) / 2 + CASE WHEN l_linestatus = 'F' THEN 0.025 ELSE 0 END AS DOUBLE), 6) AS quality,
    CAST(greatest(l_linenumber % 3, CAST(l_linestatus = 'F' AS INTEGER) + 1) AS INTEGER) AS families FROM lineitem""",
)
def observation_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = O.observation_quality(1 - F.col("l_quantity") / 100, -F.col("l_discount") * 30, F.col("l_linestatus") == "F")
    listed = F.array_repeat(F.lit("x"), F.col("l_linenumber") % 3), F.array_repeat(F.lit("y"), (F.col("l_linestatus") == "F").cast("int") + 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(quality, 6).alias("quality"), O.effective_families(*listed).alias("families"))


@query(
    "pruned_candidates",
    f"""WITH {_V}, o AS (SELECT *, confidence >= 20 AS observed FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY families DESC, round(CAST(score AS DOUBLE), 6) DESC, candidate) AS r FROM o WHERE observed OR families >= 2)
    SELECT slot, candidate, families FROM r WHERE r <= 3""",
)
def pruned_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).withColumns({"observed": F.col("confidence") >= 20, "score": F.round("score", 6)})
    return voting.pruned(rows, ["slot"], 3).select("slot", "candidate", "families")


_BASE = "b2 AS (SELECT slot, arg_max(candidate, (votes, candidate)) AS base, max(votes) AS most, count(*) AS n FROM s GROUP BY slot)"


@query(
    "candidate_gates",
    f"""WITH {_V}, {_BASE}, g AS (SELECT s.slot, s.candidate, CASE WHEN candidate <> base THEN CASE WHEN slot % 5 = 0 THEN 'locked' WHEN families < 3 THEN 'no independent family' WHEN length(candidate) < length(base) - 1 THEN 'length changes' WHEN {sim("candidate", "base")} < 0.2 THEN 'far from base' WHEN 2 * votes < most THEN 'critical' END END AS gate
    FROM s JOIN b2 USING (slot)) SELECT coalesce(gate, 'allowed') AS gate, count(*) AS n FROM g GROUP BY 1""",
)
def candidate_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir)
    best = rows.groupBy("slot").agg(F.max(F.struct("votes", "candidate")).alias("b")).select("slot", F.col("b.candidate").alias("base"), F.col("b.votes").alias("most"))
    checks = {
        "no independent family": F.col("families") < 3, "length changes": F.char_length("candidate") < F.char_length("base") - 1,
        "far from base": N.edit_similarity(F.col("candidate"), F.col("base")) < 0.2, "critical": 2 * F.col("votes") < F.col("most"),
    }
    out = O.gated(rows.join(best, "slot"), F.col("slot") % 5 == 0, F.col("candidate") == F.col("base"), checks)
    return out.groupBy(F.coalesce("gate", F.lit("allowed")).alias("gate")).agg(F.count(F.lit(1)).alias("n"))


def _scaled(name: str) -> str:
    return f"CASE WHEN max({name}) OVER (PARTITION BY slot) > min({name}) OVER (PARTITION BY slot) THEN ({name} - min({name}) OVER (PARTITION BY slot)) / (max({name}) OVER (PARTITION BY slot) - min({name}) OVER (PARTITION BY slot)) ELSE 0.5 END"


_PARTS = {"emission": "votes", "local": "families", "global": "length(candidate)", "context": "floor(confidence)", "common": "slot % 7"}


@query(
    "local_priors",
    f"""WITH {_V}, p AS (SELECT slot, candidate, {", ".join(f'CAST({e} AS DOUBLE) AS "{n}"' for n, e in _PARTS.items())} FROM s), q AS (SELECT slot, candidate, round({" + ".join(f'{w} * ({_scaled(chr(34) + n + chr(34))})' for n, w in O.LOCAL.items())}, 6) AS score FROM p),
    r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM q WINDOW w AS (PARTITION BY slot ORDER BY score DESC, candidate)), z AS (SELECT slot, candidate, score, round(score - coalesce(next, 0), 6) AS lead FROM r WHERE rank = 1)
    SELECT *, CASE WHEN lead >= 0.035 THEN round(least(6.0, 3.5 + 10.0 * lead), 6) ELSE 0.0 END AS prior FROM z""",
)
def local_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _scored(spark, sf_dir).select("slot", "candidate", *(F.expr(e).cast("double").alias(n) for n, e in _PARTS.items()))
    return O.local_priors(rows, ["slot"])


@query(
    "locked_slots",
    f"""WITH {_E}, l AS (SELECT user_id, event_id AS lock, t, 'v' || event_id AS value FROM e WHERE event_type = 'purchase' AND value >= 40), w AS (SELECT user_id, event_id AS slot, t, event_type AS word FROM e WHERE event_type <> 'purchase'),
    o AS (SELECT w.user_id, slot, min(struct_pack(s := l.t, lock := lock, value := l.value, at := w.t)) AS x FROM w JOIN l ON l.user_id = w.user_id AND abs(l.t - w.t) < 600 GROUP BY ALL),
    f AS (SELECT user_id, x.lock AS lock, min(struct_pack(at := x.at, slot := slot)) AS first FROM o GROUP BY ALL)
    SELECT w.user_id, w.slot, CASE WHEN o.slot IS NULL THEN w.word WHEN f.first.slot = w.slot THEN o.x.value ELSE '' END AS word, o.x.lock AS lock FROM w LEFT JOIN o ON o.user_id = w.user_id AND o.slot = w.slot LEFT JOIN f ON f.user_id = o.user_id AND f.lock = o.x.lock""",
)
def locked_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    locks = rows.filter("event_type = 'purchase' AND value >= 40").select("user_id", F.col("event_id").alias("lock"), "start", "end", F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("value"))
    slots = rows.filter("event_type <> 'purchase'").select("user_id", F.col("event_id").alias("slot"), "start", "end", F.col("event_type").alias("word"))
    return O.locked_slots(slots, locks, ["user_id"], BUCKET).select("user_id", "slot", "word", "lock")


@query(
    "uncertain_regions",
    f"""WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS pos FROM e), b AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 3 AND t - lag(t) OVER w <= 36000 THEN 0 ELSE 1 END AS fresh FROM n WHERE value < 8 WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM b),
    s AS (SELECT user_id, run, min(pos) - 2 AS s, max(pos) + 2 AS f, sum(CASE WHEN event_type = 'error' THEN 3 ELSE 1 END) AS severity, count(*) AS n FROM g GROUP BY ALL),
    r AS (SELECT *, max(f) OVER (PARTITION BY user_id ORDER BY s, f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, f ROWS UNBOUNDED PRECEDING) AS region FROM r),
    m AS (SELECT user_id, greatest(0, min(s)) AS first, max(f) AS last, sum(n) AS members, sum(severity) AS severity FROM i GROUP BY user_id, region)
    SELECT user_id, first, last, CAST(members AS BIGINT) AS members, round(severity / (last - first + 1), 6) AS density FROM m ORDER BY density DESC, user_id, first LIMIT 20""",
)
def uncertain_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = spans(spark, sf_dir)
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("start", "event_id")) - 1
    rows = rows.select("user_id", "event_type", "value", F.col("start").alias("at"), pos.cast("long").alias("pos"))
    severity = F.when(F.col("event_type") == "error", 3).otherwise(1)
    return O.regions(rows, ["user_id"], F.col("value") < 8, severity, 20, 3, 36000.0)


@query(
    "rule_scores",
    """SELECT event_id, round(tanh((CASE WHEN event_type = 'error' THEN 3.0 ELSE 0 END + CASE WHEN value > 50 THEN 1.5 ELSE 0 END - CASE WHEN value < 2 THEN 2.25 ELSE 0 END) / 4), 6) AS score,
    array_to_string(list_filter([CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN value > 50 THEN 'large' END, CASE WHEN value < 2 THEN 'small' END], lambda x: x IS NOT NULL), ',') AS reasons FROM events""",
)
def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, reasons = O.rule_score([("error", F.col("event_type") == "error", 3.0), ("large", F.col("value") > 50, 1.5), ("small", F.col("value") < 2, -2.25)])
    return table(spark, sf_dir, "events").select("event_id", F.round(score, 6).alias("score"), F.array_join(reasons, ",").alias("reasons"))


@query(
    "similar_neighbours",
    f"""WITH {_E}, n AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS slot, event_type AS candidate, t FROM e),
    p AS (SELECT a.user_id, a.slot, a.candidate, b.slot AS f, {sim("a.candidate", "b.candidate")} AS s FROM n a JOIN n b ON a.user_id = b.user_id AND abs(a.slot - b.slot) = 1 WHERE (600 - abs(a.t - b.t)) / 600 >= 0.35),
    w AS (SELECT user_id, slot, round(sum(CASE WHEN s >= 0.82 THEN 1.45 WHEN s >= 0.2 THEN 0.26 ELSE 0 END), 6) AS support FROM p GROUP BY ALL) SELECT n.user_id, n.slot, n.candidate, coalesce(support, 0) AS support FROM n LEFT JOIN w USING (user_id, slot)""",
)
def similar_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    slot = F.row_number().over(Window.partitionBy("user_id").orderBy("start", "event_id"))
    rows = spans(spark, sf_dir).select("user_id", slot.cast("long").alias("slot"), F.col("event_type").alias("candidate"), "start", "end")
    return O.similar_neighbours(rows, ["user_id"], "slot", N.edit_similarity, 0.82, 0.2).select("user_id", "slot", "candidate", "support")


@query(
    "verb_like_tokens",
    r"""WITH v AS (SELECT tok, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')) AS tok FROM conversations) GROUP BY tok), p AS (SELECT * FROM (VALUES ('', 'ed'), ('', 'ing'), ('', 's'), ('re', ''), ('re', 'ed'), ('re', 'ing'), ('re', 's')) AS t(p, s)),
    c AS (SELECT DISTINCT tok, tok[length(p) + 1 : length(tok) - length(s)] AS stem FROM v, p WHERE starts_with(tok, p) AND ends_with(tok, s) AND length(tok) >= length(p) + length(s) + 3) SELECT c.tok, c.stem FROM c JOIN v ON v.tok = c.stem WHERE v.n >= 3""",
)
def verb_like_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = said(spark, sf_dir).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    return O.verb_like(counts, counts.filter("n >= 3").select(F.col("tok").alias("stem")), ["re"], ["ed", "ing", "s"])


@query(
    "critical_priors",
    f"""WITH {_V} SELECT slot, candidate, round(CASE WHEN candidate = 'error' AND slot % 2 = 0 AND families >= 2 THEN 5.0 ELSE greatest(0.0, least(7.0, 10 * (CAST(votes % 10 AS DOUBLE) / 10 - 0.5))) END, 6) AS prior FROM s""",
)
def critical_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = O.critical_prior(F.col("candidate") == "error", F.col("families"), F.col("slot") % 2 == 0, (F.col("votes") % 10).cast("double") / 10)
    return _scored(spark, sf_dir).select("slot", "candidate", F.round(prior, 6).alias("prior"))


@query(
    "first_usable",
    """WITH t AS (SELECT conv_id, max(CASE WHEN role = 'assistant' THEN length(text) END) AS a, max(CASE WHEN role = 'user' THEN length(text) END) AS u, max(CASE WHEN role = 'system' THEN length(text) END) AS s FROM conversations GROUP BY conv_id)
    SELECT conv_id, CASE WHEN a >= 900 THEN 'assistant' WHEN u >= 600 THEN 'user' WHEN s >= 1 THEN 'system' END AS source, CASE WHEN a >= 900 THEN CAST(a AS VARCHAR) WHEN u >= 600 THEN CAST(u AS VARCHAR) WHEN s >= 1 THEN CAST(s AS VARCHAR) END AS text FROM t""",
)
def first_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which role a conversation goes by: the first whose longest turn is long enough, and that length."""
    longest = [F.max(F.when(F.col("role") == r, F.char_length("text"))).alias(r) for r in ("assistant", "user", "system")]
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*longest)
    parts = [(r, F.col(r).cast("string"), F.col(r) >= n) for r, n in (("assistant", 900), ("user", 600), ("system", 1))]
    return rows.select("conv_id", O.first_usable(parts).alias("x")).select("conv_id", "x.source", "x.text")
