"""Claims of assistants against what others say in the same conversation: mentions, codes, contradictions, repairs and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import claims as C
from lattica.plans.interval_queries import BUCKET, _E, spans
from lattica.plans.registry import query, table

_NUMBERS = "regexp_extract_all(coalesce({0}, ''), '[0-9]+')"
_WORDS = r"regexp_extract_all(lower(coalesce({0}, '')), '\p{{L}}+')"
NEGATIONS = {"negation": ["not", "no", "never", "ni", "pas", "nicht", "kein", "keine"], "unit": ["mg", "ml", "kg", "km"]}


def _listed(name: str, text: str) -> str:
    return f"array_to_string(list_sort(list_filter({_WORDS.format(text)}, lambda t: list_contains({NEGATIONS[name]}, t))), ',')"


def _signature(text: str) -> str:
    return f"array_to_string(list_sort({_NUMBERS.format(text)}), ',') || ';' || {_listed('negation', text)} || ';' || {_listed('unit', text)}"


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


@query(
    "signature_changes",
    f"WITH s AS (SELECT conv_id, turn, {_signature('text')} AS signature FROM conversations) SELECT conv_id, turn, signature, lag(signature) OVER w <> signature AS changed FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
def signature_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = talk(spark, sf_dir).select("conv_id", "turn", C.signature(F.col("text"), NEGATIONS).alias("signature"))
    rows = C.before(rows, ["conv_id"], ["turn"], ["signature"])
    return rows.select("conv_id", "turn", "signature", (F.col("before_signature") != F.col("signature")).alias("changed"))


_MENTIONS = f"x AS (SELECT doc_id, lang, source, unnest({_NUMBERS.format('text')}) AS value FROM documents)"


@query("number_mentions", f"WITH {_MENTIONS} SELECT lang, value, count(*) AS n, count(DISTINCT source) AS families, count(DISTINCT source) >= 2 AS agreed FROM x GROUP BY lang, value")
def number_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.mentions(table(spark, sf_dir, "documents").select("lang", F.col("source").alias("family"), "text"), ["lang"], "[0-9]+")


@query(
    "consistent_sums",
    f"WITH {_MENTIONS}, y AS (SELECT doc_id, CAST(value AS BIGINT) AS value FROM x WHERE length(value) <= 15) SELECT doc_id, count(*) AS parts, CAST(sum(value) AS BIGINT) AS total, max(value) AS stated, count(*) > 2 AND sum(value) = 2 * max(value) AS adds_up FROM y GROUP BY doc_id",
)
def consistent_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.mentions(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("family"), "text"), ["doc_id"], "[0-9]+").filter(F.length("value") <= 15)
    return C.consistent_sums(found.withColumn("value", F.col("value").cast("long")), ["doc_id"])


_CLAIMS = "c AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'), u AS (SELECT conv_id, text FROM conversations WHERE role <> 'assistant')"


def _without(what: str, name: str) -> str:
    return f"{name} AS (SELECT c.conv_id, c.turn, part FROM (SELECT DISTINCT conv_id, turn, unnest({what}) AS part FROM c) c WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT conv_id, unnest({what}) AS part FROM u) e WHERE e.conv_id = c.conv_id AND e.part = c.part))"


_CUT = r"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?]*'), lambda s: trim(s, ' ')), lambda s: s <> '')"
_LONG = f"list_filter({_WORDS.format('text')}, lambda t: length(t) >= 12)"
_NEGATIVE = f"list_filter({_WORDS.format('text')}, lambda t: list_contains({NEGATIONS['negation']}, t))"
MARKUP = r"</?[a-z]+>|```|\{\{"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = talk(spark, sf_dir)
    return rows.filter("role = 'assistant'").drop("role"), rows.filter("role <> 'assistant'").select("conv_id", "text")


def _parts(name: str):  # noqa: ANN202
    words = T.tokens(F.col("text"))
    listed = F.array(*(F.lit(w) for w in NEGATIONS["negation"]))
    return {"number": C.numbers(F.col("text")), "term": F.filter(words, lambda t: F.char_length(t) >= 12), "negation": F.filter(words, lambda t: F.array_contains(listed, t))}[name]


@query(
    "validation_codes",
    rf"""WITH {_CLAIMS}, {_without(_NUMBERS.format("text"), "n")}, {_without(_LONG, "t")}, {_without(_NEGATIVE, "g")}
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty' END, CASE WHEN length(text) > 1500 THEN 'too_long' END, CASE WHEN regexp_matches(text, '{MARKUP}') THEN 'markup' END,
    CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.conv_id = c.conv_id AND n.turn = c.turn) THEN 'unsupported_number' END, CASE WHEN EXISTS (SELECT 1 FROM t WHERE t.conv_id = c.conv_id AND t.turn = c.turn) THEN 'unsupported_term' END,
    CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.conv_id = c.conv_id AND g.turn = c.turn) THEN 'unsupported_negation' END, CASE WHEN len(list_distinct({_CUT})) < len({_CUT}) THEN 'repeated_sentence' END,
    CASE WHEN NOT regexp_matches(coalesce(text, ''), '[.!?]\s*$') THEN 'unfinished' END, CASE WHEN regexp_matches(text, '\[[^\]]*\]') THEN 'brackets' END], lambda x: x IS NOT NULL), ',') AS codes FROM c""",
)
def validation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine, its = _sides(spark, sf_dir)
    rows, text = mine, F.col("text")
    for name in ("number", "term", "negation"):
        rows = C.flagged(rows, C.missing(mine, its, ["conv_id"], ["turn"], _parts(name)), ["conv_id", "turn"], f"no_{name}")
    checks = {"empty": F.trim(F.coalesce(text, F.lit(""))) == "", "too_long": F.char_length(text) > 1500, "markup": text.rlike(MARKUP)}
    checks |= {f"unsupported_{x}": F.col(f"no_{x}") for x in ("number", "term", "negation")}
    said = C.sentences(text)
    checks |= {"repeated_sentence": F.size(F.array_distinct(said)) < F.size(said), "unfinished": ~F.coalesce(text, F.lit("")).rlike(r"[.!?]\s*$"), "brackets": text.rlike(r"\[[^\]]*\]")}
    return C.codes(rows, checks).select("conv_id", "turn", F.array_join("codes", ",").alias("codes"))


OPPOSITES = {"polarity": (r"\b(the|and)\b", r"\b(que|der)\b"), "amount": (r"[0-9]{2,}", r"\b[0-9]\b")}


def _opposite(name: str) -> str:
    a, b = OPPOSITES[name]
    mine = lambda p: f"coalesce(regexp_matches(c.text, '{p}'), false)"
    its = lambda k: f"coalesce(e.{name}{k}, false)"
    return f"CASE WHEN ({mine(a)} AND NOT {mine(b)} AND {its(1)} AND NOT {its(0)}) OR ({mine(b)} AND NOT {mine(a)} AND {its(0)} AND NOT {its(1)}) THEN '{name}' END"


@query(
    "contradictions",
    f"""WITH {_CLAIMS}, e AS (SELECT conv_id, {", ".join(f"bool_or(coalesce(regexp_matches(text, '{p}'), false)) AS {name}{k}" for name, pair in OPPOSITES.items() for k, p in enumerate(pair))} FROM u GROUP BY conv_id)
    SELECT c.conv_id, c.turn, array_to_string(list_filter([{", ".join(map(_opposite, OPPOSITES))}], lambda x: x IS NOT NULL), ',') AS contradictions FROM c LEFT JOIN e ON e.conv_id = c.conv_id""",
)
def contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine, its = _sides(spark, sf_dir)
    return C.contradictions(mine, its, ["conv_id"], OPPOSITES).select("conv_id", "turn", F.array_join("contradictions", ",").alias("contradictions"))




@query(
    "repaired_claims",
    rf"""WITH {_CLAIMS}, {_without(_NUMBERS.format("text"), "n")}, {_without(_LONG, "t")}, nn AS (SELECT conv_id, turn, list(part) AS ns FROM n GROUP BY ALL), tt AS (SELECT conv_id, turn, list(part) AS ts FROM t GROUP BY ALL),
    a AS (SELECT c.conv_id, c.turn, text, coalesce(ns, []) AS ns, coalesce(ts, []) AS ts FROM c LEFT JOIN nn ON nn.conv_id = c.conv_id AND nn.turn = c.turn LEFT JOIN tt ON tt.conv_id = c.conv_id AND tt.turn = c.turn),
    b AS (SELECT *, array_to_string(list_filter({_CUT}, lambda s: NOT list_has_any(regexp_extract_all(s, '[0-9]+'), ns)), ' ') AS kept FROM a),
    d AS (SELECT *, regexp_replace(array_to_string(list_transform(string_split(kept, ' '), lambda p: CASE WHEN list_contains(ts, lower(regexp_replace(p, '[^\p{{L}}]+', '', 'g'))) THEN '[?]' ELSE p END), ' '), '\[\?\]( \[\?\])+', '[?]', 'g') AS repaired FROM b)
    SELECT conv_id, turn, sha256(repaired) AS repaired_sha256, CAST(length(repaired) AS INTEGER) AS n_chars, len({_WORDS.format("kept")}) >= 8 AND len({_WORDS.format("kept")}) >= 0.45 * len({_WORDS.format("text")}) AS retained,
    CASE WHEN len(ns) + len(ts) > 0 THEN 'low' ELSE 'stated' END AS confidence FROM d""",
)
def repaired_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with numbers that nobody else says go, long words that nobody else says are marked, and confidence falls where anything was repaired."""
    mine, its = _sides(spark, sf_dir)
    rows = mine
    for name in ("number", "term"):
        found = C.missing(mine, its, ["conv_id"], ["turn"], _parts(name)).groupBy("conv_id", "turn").agg(F.collect_list("part").alias(name))  # parts of one turn
        rows = rows.join(found, ["conv_id", "turn"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    rows = rows.withColumn("kept", C.without_sentences(F.col("text"), F.col("number")))
    rows = rows.withColumn("repaired", C.redacted_words(F.col("kept"), F.col("term")))
    count = lambda c: F.size(T.tokens(F.col(c)))
    touched = F.size("number") + F.size("term") > 0
    return rows.select(
        "conv_id", "turn", F.sha2("repaired", 256).alias("repaired_sha256"), F.char_length("repaired").alias("n_chars"), C.retained(count("text"), count("kept")).alias("retained"),
        F.when(touched, "low").otherwise("stated").alias("confidence"),
    )


@query("ordered_coverage")
def ordered_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a turn the next one repeats in order."""
    rows = talk(spark, sf_dir).select("conv_id", "turn", T.tokens(F.col("text")).alias("toks"))
    rows = C.before(rows, ["conv_id"], ["turn"], ["toks"]).filter("before_toks IS NOT NULL")
    rows = rows.select("conv_id", "turn", F.round(C.ordered_coverage("before_toks", "toks"), 6).alias("coverage"))
    return rows.withColumn("faithful", F.col("coverage") >= C.COVERED)


_NOISE = r"len(regexp_extract_all({0}, '[^\p{{L}}\s.,!?]')) / greatest(1, length({0}))"


@query(
    "choice_reasons",
    rf"""WITH b AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lag(coalesce(text, '')) OVER w AS p, lag(role) OVER w AS pr FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, CASE WHEN length(p) = 0 OR length(text) / length(p) NOT BETWEEN 0.55 AND 1.80 THEN 'length' WHEN round({_NOISE.format("text")}, 9) > round({_NOISE.format("p")}, 9) THEN 'anomaly'
    WHEN list_sort({_NUMBERS.format("text")}) <> list_sort({_NUMBERS.format("p")}) AND pr = role THEN 'sensitive' ELSE 'accepted' END AS reason FROM b WHERE p IS NOT NULL""",
)
def choice_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, first = F.col("text"), F.col("before_text")
    rows = talk(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    rows = C.before(rows, ["conv_id"], ["turn"], ["text", "role"]).filter("before_text IS NOT NULL")
    noise = lambda c: F.round(F.regexp_count(c, F.lit(r"[^\p{L}\s.,!?]")) / F.greatest(F.lit(1), F.char_length(c)), 9)
    families = F.when(F.col("before_role") == F.col("role"), 1).otherwise(2)
    reason = C.choice_reason(F.char_length(first), F.char_length(text), C.numbers(text) != C.numbers(first), families, noise(first), noise(text))
    return rows.select("conv_id", "turn", F.coalesce(reason, F.lit("accepted")).alias("reason"))


@query(
    "replaced_rows",
    """WITH e AS (SELECT conv_id, turn // 2 AS pair, text, length(coalesce(text, '')) < 300 AS bad FROM conversations WHERE role = 'assistant'), r AS (SELECT conv_id, turn // 2 AS pair, any_value(text) AS text, length(coalesce(any_value(text), '')) < 300 AS bad FROM conversations WHERE role = 'user' GROUP BY conv_id, turn // 2),
    x AS (SELECT e.conv_id, e.pair, e.text, r.text AS raw, coalesce(e.bad AND NOT r.bad AND trim(coalesce(r.text, '')) <> '', false) AS repaired FROM e LEFT JOIN r ON r.conv_id = e.conv_id AND r.pair = e.pair)
    SELECT conv_id, pair, sha256(coalesce(CASE WHEN repaired THEN raw ELSE text END, '')) AS text_sha256, repaired FROM x""",
)
def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short assistant turn gives way to the user's of the same pair of turns, if that is not short."""
    rows = talk(spark, sf_dir).select("conv_id", "role", F.floor(F.col("turn") / 2).alias("pair"), "text")
    of = lambda role: rows.filter(F.col("role") == role).drop("role").withColumn("bad", F.char_length(F.coalesce("text", F.lit(""))) < 300)
    raw = of("user").groupBy("conv_id", "pair").agg(F.min("text").alias("text"), F.min("bad").alias("bad"))
    out = C.replaced_rows(raw, of("assistant"), ["conv_id", "pair"], ["text"])
    return out.select("conv_id", "pair", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "repaired")


@query(
    "interval_stitch",
    f"""WITH {_E}, s AS (SELECT user_id, event_id AS segment, t, event_type || ':' || event_id AS text, value < 20 AS reviewed FROM e WHERE event_type = 'view'), w AS (SELECT user_id, t, CAST(event_id AS VARCHAR) AS word FROM e WHERE event_type = 'click'),
    j AS (SELECT s.user_id, segment, string_agg(word, ' ' ORDER BY w.t, word) AS said FROM s JOIN w ON w.user_id = s.user_id AND w.t BETWEEN s.t AND s.t + 600 WHERE reviewed GROUP BY ALL)
    SELECT s.user_id, s.segment, coalesce(nullif(trim(said), ''), text) AS text, reviewed FROM s LEFT JOIN j ON j.user_id = s.user_id AND j.segment = s.segment""",
)
def interval_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans(spark, sf_dir)
    text = F.concat("event_type", F.lit(":"), F.col("event_id").cast("string"))
    segments = rows.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("segment"), "start", "end", text.alias("text"), (F.col("value") < 20).alias("reviewed"))
    words = rows.filter("event_type = 'click'").select("user_id", F.col("start").alias("at"), F.col("event_id").cast("string").alias("word"))
    return C.stitched(segments, words, ["user_id"], BUCKET)


def _tail(n: int) -> str:
    return f"CASE WHEN len(p) >= {n} AND len(w) >= {n} AND p[len(p) - {n - 1} :] = w[1 : {n}] THEN w[{n + 1} :] END"


@query(
    "boundary_trim",
    f"""WITH d AS (SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[^\\n]+'), lambda x: true)) AS line, unnest(range(len(regexp_extract_all(lower(coalesce(text, '')), '[^\\n]+')))) AS pos FROM documents),
    t AS (SELECT doc_id, pos, {_WORDS.format("line")} AS w FROM d), b AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS p FROM t)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(len(coalesce({_tail(3)}, {_tail(2)}, {_tail(1)}, w)) AS INTEGER) AS n_words FROM b WHERE p IS NOT NULL""",
)
def boundary_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left of each line once those that the line before ends with are taken from its begin."""
    lines = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[^\n]+"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("pos", "line")).select("doc_id", "pos", T.tokens(F.col("line")).alias("w"))
    rows = C.before(rows, ["doc_id"], ["pos"], ["w"]).filter("before_w IS NOT NULL")
    return rows.select("doc_id", "pos", F.size(C.trimmed(F.col("before_w"), F.col("w"))).alias("n_words"))


@query(
    "recheck_verdicts",
    """SELECT l_returnflag, verdict, count(*) AS n FROM (SELECT l_returnflag, CASE WHEN l_quantity * 2 >= 65 AND l_discount * 1000 >= 75 THEN 'CONFLICT' WHEN l_quantity * 2 >= 65 THEN 'CONFIRMED' WHEN l_discount * 1000 >= 75 AND l_tax > 0.02 THEN 'REJECTED' ELSE 'UNCLEAR' END AS verdict FROM lineitem) GROUP BY ALL""",
)
def recheck_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = C.recheck_verdict(F.col("l_quantity") * 2, F.col("l_discount") * 1000, F.col("l_tax") > 0.02)
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "agreed_polarity",
    f"""WITH f AS (SELECT conv_id, role, bool_or(list_has_any({_WORDS.format("text")}, ['the', 'que', 'der'])) AS no FROM conversations GROUP BY ALL), c AS (SELECT conv_id, count(*) FILTER (no) AS negative, count(*) FILTER (NOT no) AS positive FROM f GROUP BY conv_id)
    SELECT *, CASE WHEN negative >= 2 AND negative > positive THEN 'negative' WHEN positive >= 2 AND positive > negative THEN 'positive' END AS polarity FROM c""",
)
def agreed_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.agreed_polarity(talk(spark, sf_dir).withColumnRenamed("role", "family"), ["conv_id"], ["the", "que", "der"])
