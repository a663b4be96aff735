"""Queries of what stands around a row: local evidence, vocabulary, neighbours, gates, redaction and completeness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import context as C
from lattica.operators import corpus, grounding
from lattica.operators import intervals as I
from lattica.plans.corpus_queries import _DISTINCT, _distinct, _grams
from lattica.plans.interval_queries import BUCKET, _E, spans
from lattica.plans.registry import query, table
from lattica.plans.vote_queries import _TOKS, _V, _scored

_MAIL, _NUMBER = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+( [0-9]+)+"


@query(
    "local_gram_evidence",
    rf"""WITH t AS (SELECT role AS family, {_TOKS} AS w FROM conversations), g AS (SELECT family, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: array_to_string(w[i : i + 1], ' '))) AS gram FROM t)
    SELECT gram, count(*) AS n_count, count(DISTINCT family) AS n_families FROM g GROUP BY gram HAVING count(DISTINCT family) >= 2""",
)
def local_gram_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.local_evidence(table(spark, sf_dir, "conversations").select(F.col("role").alias("family"), T.tokens(F.col("text")).alias("toks")), 2)


@query(
    "vocabulary_membership",
    rf"""WITH t AS (SELECT unnest({_TOKS}) AS tok FROM documents), c AS (SELECT tok, count(*) AS n_count FROM t GROUP BY tok), z AS (SELECT *, log10(n_count / (SELECT sum(n_count) FROM c) * 1e9) AS zipf FROM c)
    SELECT tok, n_count, round(zipf, 4) AS zipf, zipf >= 3.25 AS is_member FROM z""",
)
def vocabulary_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("tok"))
    return C.vocabulary(words).withColumn("zipf", F.round("zipf", 4))


@query(
    "active_words",
    rf"""WITH t AS (SELECT unnest({_TOKS}) AS tok FROM documents), c AS (SELECT tok, count(*) AS n_count FROM t GROUP BY tok), z AS (SELECT *, log10(n_count / (SELECT sum(n_count) FROM c) * 1e9) AS zipf FROM c),
    s AS (SELECT tok, tok[1 : length(tok) - length(e)] AS stem FROM c, (VALUES ('s'), ('ing'), ('ed')) AS e(e) WHERE ends_with(tok, e) AND length(tok) >= length(e) + 3),
    f AS (SELECT tok, 'common' AS why FROM z WHERE zipf >= 3.25 UNION ALL SELECT unnest({_TOKS}) AS tok, 'allowed' FROM benchmark UNION ALL SELECT s.tok, 'stem' FROM s JOIN z ON z.tok = s.stem WHERE z.zipf >= 4.0)
    SELECT tok, min(why) AS why FROM f WHERE tok NOT IN (SELECT unnest({_TOKS}) FROM conversations WHERE role = 'system' AND text IS NOT NULL) GROUP BY tok""",
)
def active_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.operators.slots import verb_like

    words = lambda t, rows=None: (rows if rows is not None else table(spark, sf_dir, t)).select(F.explode(T.tokens(F.col("text"))).alias("tok"))
    known = C.vocabulary(words("documents"))
    stems = verb_like(known, known.select(F.col("tok").alias("stem")), [], ["s", "ing", "ed"])
    blocked = words("conversations", table(spark, sf_dir, "conversations").filter("role = 'system'"))
    return C.active_words(known, words("benchmark"), blocked, stems)


@query(
    "bridge_words",
    rf"""WITH w AS (SELECT conv_id, turn, role, unnest({_TOKS}) AS tok, unnest(range(len({_TOKS}))) AS pos FROM conversations), f AS (SELECT conv_id, tok, count(DISTINCT role) AS families FROM w GROUP BY ALL),
    g AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM (SELECT {_TOKS} AS t FROM documents)),
    n AS (SELECT w.conv_id, turn, pos, tok, families, lag(tok) OVER o AS a, lead(tok) OVER o AS b, lag(families) OVER o AS fa, lead(families) OVER o AS fb FROM w JOIN f USING (conv_id, tok) WINDOW o AS (PARTITION BY w.conv_id, turn ORDER BY pos))
    SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, tok FROM n WHERE families < 2 AND fa >= 2 AND fb >= 2 AND a || ' ' || b IN (SELECT g FROM g)""",
)
def bridge_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that one role says, between two that others say too and that stand side by side in the documents."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(T.tokens(F.col("text"))).alias("pos", "tok"))
    by = rows.groupBy("conv_id", "tok", "role").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id", "tok").agg(F.count(F.lit(1)).alias("families"))
    docs = table(spark, sf_dir, "documents").select(F.lit("all").alias("domain"), T.tokens(F.col("text")).alias("toks"))
    pairs = corpus.windows(docs, 2).select(F.col("w1").alias("a"), F.col("w2").alias("b"))
    out = C.without_bridges(rows.join(by, ["conv_id", "tok"]), ["conv_id", "turn"], ["pos"], "tok", "families", pairs)
    return out.filter("rewritten IS NULL").select("conv_id", "turn", "pos", "tok")


@query("domain_pivot", f"WITH {_DISTINCT}, {_grams(1)} SELECT gram, " + ", ".join(f"CAST(coalesce(sum(n_count) FILTER (domain = '{x}'), 0) AS BIGINT) AS {x}" for x in ("de", "en", "es", "fr")) + " FROM g GROUP BY gram")
def domain_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.pivoted(corpus.ngrams(_distinct(spark, sf_dir), 1), "gram", "domain", ["de", "en", "es", "fr"], "n_count")


@query(
    "uncertainty_reasons",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN value < 5 THEN 'low_value' END, CASE WHEN event_type = 'error' THEN 'error' END, CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90 THEN 'high_k' END], lambda x: x IS NOT NULL), ',') AS reasons
    FROM events WHERE value < 5 OR event_type = 'error' OR CAST(json_extract_string(props, '$.k') AS BIGINT) >= 90""",
)
def uncertainty_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"low_value": F.col("value") < 5, "error": F.col("event_type") == "error", "high_k": F.get_json_object("props", "$.k").cast("long") >= 90}
    rows = table(spark, sf_dir, "events").select("event_id", grounding.all_reasons(checks).alias("reasons"))
    return rows.filter(F.size("reasons") > 0).withColumn("reasons", F.array_join("reasons", ","))


_BY_TIME = "PARTITION BY user_id ORDER BY ts, event_id"


@query("lead_frame", f"SELECT event_id, array_to_string(coalesce(list(event_type) OVER ({_BY_TIME} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), []), ' ') AS frame FROM events")
def lead_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.lead_frame(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    return rows.select("event_id", F.array_join("frame", " ").alias("frame"))


@query(
    "first_following",
    f"""WITH x AS (SELECT event_id, min(CASE WHEN event_type IN ('error', 'purchase') THEN struct_pack(t := ts, id := event_id) END) OVER ({_BY_TIME} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM events)
    SELECT event_id, f.id AS following FROM x""",
)
def first_following(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return C.first_following(rows, ["user_id"], ["ts", "event_id"], F.col("event_type").isin("error", "purchase"), "event_id").select("event_id", "following")


@query(
    "neighbour_rewrite",
    f"SELECT event_id, CASE WHEN coalesce(lag(event_type) OVER w = event_type AND lead(event_type) OVER w = event_type, false) THEN NULL ELSE event_type END AS rewritten FROM events WINDOW w AS ({_BY_TIME})",
)
def neighbour_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return C.without_echoes(rows, ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "rewritten")


@query(
    "prefix_overlap",
    rf"""WITH t AS (SELECT conv_id, turn, {_TOKS} AS w FROM conversations), e AS (SELECT conv_id, turn, w, unnest(range(1, len(w))) AS i FROM t)
    SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS pos, w[i] AS tok, w[i + 1] AS next_tok FROM e WHERE least(length(w[i]), length(w[i + 1])) >= 3 AND (starts_with(w[i], w[i + 1]) OR starts_with(w[i + 1], w[i]))""",
)
def prefix_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("w"))
    pairs = rows.select("conv_id", "turn", F.posexplode("w").alias("pos", "tok"), "w").withColumn("next_tok", F.get("w", F.col("pos") + 1))
    return pairs.filter(C.prefix_overlaps(F.col("tok"), F.col("next_tok"))).drop("w")


@query(
    "overlap_concat",
    f"""WITH {_E}, a AS (SELECT * FROM e WHERE event_type = 'error'), b AS (SELECT * FROM e WHERE event_type = 'view')
    SELECT a.event_id, count(*) AS n, string_agg(CAST(b.event_id AS VARCHAR), ' ' ORDER BY b.t, b.event_id) AS text FROM a JOIN b ON a.user_id = b.user_id AND a.t < b.t + 600 AND b.t < a.t + 600 GROUP BY a.event_id""",
)
def overlap_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir).select("event_id", "user_id", "event_type", "start", "end")
    a, b = (rows.filter(F.col("event_type") == x).drop("event_type") for x in ("error", "view"))
    pairs = I.overlaps(a, b, ["user_id"], BUCKET).select(F.col("l_event_id").alias("event_id"), "r_start", "r_event_id", F.col("r_event_id").cast("string").alias("id"))
    return C.ordered_text(pairs, ["event_id"], ["r_start", "r_event_id"], "id")


@query(
    "alternatives_union",
    r"""WITH a AS (SELECT unnest(regexp_extract_all(lower(p_name), '\p{L}+')) AS key, 'part' AS family FROM part UNION ALL SELECT unnest(regexp_extract_all(lower(s_name), '\p{L}+')), 'supplier' FROM supplier
    UNION ALL SELECT unnest(regexp_extract_all(lower(p_type), '\p{L}+')), 'type' FROM part) SELECT key, count(*) AS n, array_to_string(list_sort(list(DISTINCT family)), ',') AS families FROM a GROUP BY key""",
)
def alternatives_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"part": ("part", "p_name"), "supplier": ("supplier", "s_name"), "type": ("part", "p_type")}
    parts = {k: table(spark, sf_dir, t).select(F.explode(T.tokens(F.col(c))).alias("key")) for k, (t, c) in named.items()}
    return C.alternatives(parts).withColumn("families", F.array_join("families", ","))


@query("severity_topk", "SELECT event_id, event_type, value FROM events ORDER BY value DESC, event_id LIMIT 18")
def severity_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "value").orderBy(F.desc("value"), "event_id").limit(18).orderBy("event_id")


@query(
    "capped_per_group",
    "SELECT user_id, event_id, value, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place FROM events) WHERE place <= 2 ORDER BY value DESC, event_id LIMIT 20",
)
def capped_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.capped(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], [F.desc("value"), F.asc("event_id")], 2, 20)


@query(
    "gate_reasons",
    """SELECT l_returnflag, CASE WHEN l_discount >= 0.09 THEN 'discount' WHEN l_quantity > 45 THEN 'quantity' WHEN l_tax = 0 THEN 'untaxed' WHEN l_linestatus = 'O' THEN 'open' ELSE 'allowed' END AS reason,
    count(*) AS n FROM lineitem GROUP BY ALL""",
)
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = {"discount": F.col("l_discount") >= 0.09, "quantity": F.col("l_quantity") > 45, "untaxed": F.col("l_tax") == 0, "open": F.col("l_linestatus") == "O"}
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.coalesce(grounding.first_reason(checks), F.lit("allowed")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "vote_gate",
    f"""WITH {_V}, x AS (SELECT *, count(*) OVER (PARTITION BY slot) AS n, max(families) OVER (PARTITION BY slot) AS most FROM s)
    SELECT slot, candidate, families, round(CAST(score + CASE WHEN n = 1 THEN 1.5 ELSE 0 END AS DOUBLE), 4) AS gated FROM x WHERE families = most""",
)
def vote_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.vote_gate(_scored(spark, sf_dir), ["slot"]).select("slot", "candidate", "families", F.round("gated", 4).alias("gated"))


@query(
    "corpus_bonus",
    rf"""WITH d AS (SELECT 'all' AS domain, {_TOKS} AS toks FROM documents), {_grams(1, 'u')}, {_grams(2, 'b')}, {_grams(3, 't')},
    c AS (SELECT {_TOKS} AS w FROM conversations), q AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i : i + 2], ' '))) AS gram FROM c),
    x AS (SELECT q.gram, coalesce(u.n_count, 0) AS n1, coalesce(b.n_count, 0) AS n2, coalesce(t.n_count, 0) AS n3 FROM q LEFT JOIN u ON u.gram = split_part(q.gram, ' ', 3)
    LEFT JOIN b ON b.gram = split_part(q.gram, ' ', 2) || ' ' || split_part(q.gram, ' ', 3) LEFT JOIN t ON t.gram = q.gram)
    SELECT gram, round(CASE WHEN n2 > 0 OR n3 > 0 THEN least(0.18, 0.020 * least(ln(1 + n1), 5) + 0.145 * least(ln(1 + n2), 5) + 0.235 * least(ln(1 + n3), 5.5)) ELSE 0.0 END, 5) AS bonus FROM x""",
)
def corpus_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("all").alias("domain"), T.tokens(F.col("text")).alias("toks"))
    asked = table(spark, sf_dir, "conversations").select(F.lit("all").alias("domain"), T.tokens(F.col("text")).alias("toks"))
    rows = corpus.ngrams(asked, 3).select("gram")
    tail = lambda k: F.array_join(F.slice(F.split("gram", " "), 4 - k, k), " ")
    for n in (1, 2, 3):
        counts = corpus.ngrams(docs, n).select(F.col("gram").alias(f"g{n}"), F.col("n_count").alias(f"n{n}"))
        rows = rows.withColumn(f"g{n}", tail(n)).join(counts, f"g{n}", "left").fillna(0, [f"n{n}"])
    return rows.select("gram", F.round(C.corpus_bonus(F.col("n1"), F.col("n2"), F.col("n3")), 5).alias("bonus"))


@query("redacted_texts", f"SELECT doc_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '{_MAIL}', '[MAIL]', 'g'), '{_NUMBER}', '[NUMBERS]', 'g')) AS redacted_sha256 FROM documents")
def redacted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    redacted = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), _MAIL, "[MAIL]"), _NUMBER, "[NUMBERS]")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(redacted, 256).alias("redacted_sha256"))


@query("missing_expected", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderstatus = 'P')")
def missing_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(found, "c_custkey", "left_anti")


@query(
    "domain_mix",
    """WITH x AS (SELECT user_id, count(*) FILTER (event_type = 'purchase' AND value < 20) AS cues, count(*) FILTER (event_type = 'error' AND value < 20) AS terms FROM events GROUP BY user_id)
    SELECT user_id, cues, terms, CAST(CASE WHEN cues >= 6 OR terms >= 12 THEN 0.90 WHEN cues >= 2 OR terms >= 4 THEN 0.76 WHEN cues + terms > 0 THEN 0.55 ELSE 0.25 END AS DOUBLE) AS mix FROM x""",
)
def domain_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = {name: F.count_if((F.col("event_type") == kind) & (F.col("value") < 20)).alias(name) for name, kind in (("cues", "purchase"), ("terms", "error"))}
    return table(spark, sf_dir, "events").groupBy("user_id").agg(*hits.values()).withColumn("mix", C.domain_mix(F.col("cues"), F.col("terms")))


@query("reason_union", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS reasons FROM events GROUP BY user_id")
def reason_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("reasons"))


@query(
    "length_ratio_gate",
    """WITH x AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, lag(length(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, turn, round(n / before, 6) AS ratio, n / before BETWEEN 0.55 AND 1.80 AS accepted FROM x WHERE before > 0""",
)
def length_ratio_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.length(F.coalesce("text", F.lit("")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"), F.lag(n).over(Window.partitionBy("conv_id").orderBy("turn")).alias("before")).filter("before > 0")
    ratio = F.col("n") / F.col("before")
    return rows.select("conv_id", "turn", F.round(ratio, 6).alias("ratio"), ratio.between(grounding.SHORTEST, grounding.LONGEST).alias("accepted"))


@query(
    "table_completeness",
    " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows, count(*) > 0 AS complete FROM {t}" for t in ("benchmark", "conversations", "documents", "embeddings", "labels", "pages")),
)
def table_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t in ("benchmark", "conversations", "documents", "embeddings", "labels", "pages"):
        n = F.count(F.lit(1))
        one = table(spark, sf_dir, t).agg(F.lit(t).alias("name"), n.alias("n_rows"), (n > 0).alias("complete"))
        out = one if out is None else out.unionByName(one)
    return out
