"""Names and phrases heard differently, over conversations, benchmark words and part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import names as N
from lattica.operators import retrieval
from lattica.operators.shared import stored
from lattica.plans.registry import query, table

_TOKS = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')"
_SIM = "(CASE WHEN greatest(length({a}), length({b})) > 0 THEN 1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) ELSE 1.0 END)"
_KEY = "{0}[1:1] || regexp_replace({0}[2:], '[aeiou]', '', 'g')"
_FOLD = "translate(lower({0}), 'bvdgjzkqy', 'pftccscci')"


def sim(a: str, b: str) -> str:
    """DuckDB compares bytes, so each letter outside ASCII that the tables have stands for itself as one byte."""
    one = lambda x: f"translate({x}, 'ßáâäçèéêíîñóöúü', '0123456789!%&+-')"
    return _SIM.format(a=one(a), b=one(b))


def key(x: str) -> str:
    return _KEY.format(f"({_FOLD.format(x)})")


def _first(c):  # noqa: ANN001, ANN202
    return F.substring(c, 1, 1)


def said(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(T.tokens(F.col("text"))).alias("pos", "tok"))


@query(
    "fuzzy_vote",
    f"""WITH o AS (SELECT DISTINCT conv_id, role AS family, unnest({_TOKS}) AS token FROM conversations), t AS (SELECT DISTINCT tok AS term, {key("tok")} AS identity, length(tok) >= 9 AS is_strict FROM (SELECT unnest({_TOKS}) AS tok FROM benchmark)),
    d AS (SELECT DISTINCT token FROM o), p AS (SELECT token, identity, is_strict, {sim("token", "term")} AS s FROM d JOIN t ON token[1:1] = term[1:1] AND abs(length(token) - length(term)) <= CASE WHEN length(token) <= 4 THEN 1 ELSE 2 END),
    m AS (SELECT token, identity, max(s) AS s FROM p WHERE s >= CASE WHEN is_strict THEN 0.85 ELSE 0.75 END GROUP BY ALL), f AS (SELECT conv_id, family, identity, max(s) AS best FROM o JOIN m USING (token) GROUP BY ALL),
    v AS (SELECT conv_id, identity, count(*) AS families, round(avg(best), 6) AS similarity FROM f GROUP BY ALL HAVING count(*) >= 2)
    SELECT conv_id, identity, families, similarity FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY families DESC, similarity DESC, identity) AS r FROM v) WHERE r = 1""",
)
def fuzzy_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    observed = said(spark, sf_dir).select("conv_id", F.col("role").alias("family"), F.col("tok").alias("token"))
    words = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct()
    terms = words.select("term", T.latin_key(F.col("term")).alias("identity"), (F.char_length("term") >= 9).alias("is_strict"))
    return N.fuzzy_vote(observed, terms, N.edit_similarity, _first, ["conv_id"], 0.85, 0.75)


_NAMES = "t AS (SELECT DISTINCT p_name AS term, p_type AS kind FROM part)"


@query(
    "two_key_matches",
    f"""WITH {_NAMES}, k AS (SELECT *, {key("term")} AS key FROM t), a AS (SELECT x.kind, x.term, y.term AS match, {sim("x.term", "y.term")} AS s FROM k x JOIN k y ON x.kind = y.kind AND x.term <> y.term AND abs(length(x.term) - length(y.term)) <= 3),
    b AS (SELECT x.kind, x.term, y.term AS match, {sim("x.key", "y.key")} AS s FROM k x JOIN k y ON x.kind = y.kind AND x.term <> y.term AND abs(length(x.key) - length(y.key)) <= 3),
    u AS (SELECT * FROM a WHERE s >= 0.5 UNION ALL SELECT * FROM b WHERE s >= 0.6) SELECT kind, term, match, round(max(s), 6) AS similarity FROM u GROUP BY ALL""",
)
def two_key_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.col("p_type").alias("kind")).distinct()
    return N.two_key_matches(rows, rows, T.latin_key, N.edit_similarity, ["kind"], 3, 0.5, 0.6).withColumn("similarity", F.round("similarity", 6))


_SAID = f"w AS (SELECT conv_id, turn, role, unnest({_TOKS}) AS tok, unnest(range(len({_TOKS}))) AS pos FROM conversations)"
_AHEAD = "OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {0} FOLLOWING)"


@query(
    "token_frames",
    f"""WITH {_SAID}, z AS (SELECT *, min(CASE WHEN tok IN ('in', 'en') THEN pos END) {_AHEAD.format(3)} AS third FROM w),
    y AS (SELECT *, min(CASE WHEN tok IN ('of', 'de', 'der') AND third IS NOT NULL THEN struct_pack(p := pos, q := third) END) {_AHEAD.format(8)} AS chain FROM z)
    SELECT conv_id, turn, CAST(pos AS INTEGER) AS at_0, CAST(chain.p AS INTEGER) AS at_1, CAST(chain.q AS INTEGER) AS at_2 FROM y WHERE tok IN ('the', 'la', 'die') AND chain IS NOT NULL""",
)
def token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.frames(said(spark, sf_dir), ["conv_id", "turn"], [["the", "la", "die"], ["of", "de", "der"], ["in", "en"]], [8, 3])


@query(
    "frame_winners",
    f"""WITH {_SAID}, y AS (SELECT *, min(CASE WHEN tok IN ('of', 'de', 'der') THEN pos END) {_AHEAD.format(8)} AS y FROM w),
    f AS (SELECT y.conv_id, n.tok AS candidate FROM y JOIN w n ON n.conv_id = y.conv_id AND n.turn = y.turn AND n.pos = y.y + 1 WHERE y.tok IN ('the', 'la', 'die') AND y.y IS NOT NULL),
    c AS (SELECT conv_id, candidate, count(*) AS n FROM f GROUP BY ALL), s AS (SELECT *, round(1.0 * (n / sum(n) OVER (PARTITION BY conv_id)), 6) AS score FROM c),
    r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS next FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY score DESC, candidate))
    SELECT conv_id, candidate, n, score, round(score - coalesce(next, 0), 6) AS lead, score >= 0 AND round(score - coalesce(next, 0), 6) >= 0.08 AND n >= 2 AS accepted FROM r WHERE rank = 1""",
)
def frame_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows a frame's second word, by conversation: the winner needs two occurrences and a lead."""
    words, at = said(spark, sf_dir), ["conv_id", "turn"]
    found = N.frames(words, at, [["the", "la", "die"], ["of", "de", "der"]], [8]).select(*at, (F.col("at_1") + 1).alias("pos"))
    counts = words.join(found, [*at, "pos"]).groupBy("conv_id", F.col("tok").alias("candidate")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("conv_id").agg(F.sum("n").alias("total"))
    rows = counts.join(totals, "conv_id").select("conv_id", "candidate", "n", (F.col("n") / F.col("total")).alias("share"))
    out = N.weighted_choice(rows, ["conv_id"], "candidate", {"share": 1.0}, 0.0, 0.08).drop("share")
    return out.withColumn("accepted", F.col("accepted") & (F.col("n") >= 2))


# The parts of a repair's score.
REPAIR = {"similarity": 0.32, "before": 0.24, "after": 0.22, "common": 0.22}


@query(
    "weighted_repairs",
    f"""WITH {_SAID}, v AS (SELECT tok, count(*) AS n FROM (SELECT unnest({_TOKS}) AS tok FROM documents) GROUP BY tok), m AS (SELECT max(n) AS m FROM v),
    c AS (SELECT conv_id, turn, pos, tok, lag(tok) OVER o AS p, lead(tok) OVER o AS f FROM w WINDOW o AS (PARTITION BY conv_id, turn ORDER BY pos)), x AS (SELECT c.* FROM c ANTI JOIN v USING (tok)),
    g AS (SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM (SELECT {_TOKS} AS t FROM documents)) GROUP BY g),
    t AS (SELECT DISTINCT unnest({_TOKS}) AS term FROM benchmark), u AS (SELECT DISTINCT tok FROM x),
    k AS (SELECT tok, term, {sim("tok", "term")} AS s FROM u JOIN t ON tok[1:1] = term[1:1] AND abs(length(tok) - length(term)) <= CASE WHEN length(tok) <= 4 THEN 1 ELSE 2 END),
    a AS (SELECT x.*, k.term, k.s, ln(1 + coalesce(l.n, 0)) / 8 AS b1, ln(1 + coalesce(r.n, 0)) / 8 AS b2, ln(1 + coalesce(v.n, 0)) / ln(1 + m.m) AS b3 FROM x JOIN k USING (tok) LEFT JOIN g l ON l.g = x.p || ' ' || k.term LEFT JOIN g r ON r.g = k.term || ' ' || x.f LEFT JOIN v ON v.tok = k.term, m WHERE k.s >= 0.6),
    s AS (SELECT *, round(CAST(0.32 * s + 0.24 * b1 + 0.22 * b2 + 0.22 * b3 AS DOUBLE), 6) AS score FROM a), r AS (SELECT *, row_number() OVER o AS rank, lead(score) OVER o AS next FROM s WINDOW o AS (PARTITION BY conv_id, turn, pos ORDER BY score DESC, term))
    SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, tok, term, score, round(score - coalesce(next, 0), 6) AS lead, score >= 0.30 AND round(score - coalesce(next, 0), 6) >= 0.035 AS accepted FROM r WHERE rank = 1""",
)
def weighted_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the documents don't have, each with the benchmark word that suits spelling, neighbours and frequency best."""
    from pyspark.sql import Window

    from lattica.operators import corpus

    docs = table(spark, sf_dir, "documents").select(F.lit(1).alias("domain"), T.tokens(F.col("text")).alias("toks"))
    counts = docs.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))
    pairs = corpus.ngrams(docs, 2).select("gram", F.col("n_count").alias("n"))
    place = Window.partitionBy("conv_id", "turn").orderBy("pos")
    words = said(spark, sf_dir).drop("role").withColumns({"p": F.lag("tok").over(place), "f": F.lead("tok").over(place)})
    unknown = words.join(counts.select("tok"), "tok", "left_anti")
    terms = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct().select("term", F.col("term").alias("identity"), F.lit(False).alias("is_strict"))
    near = N.matched_terms(unknown.select(F.col("tok").alias("token")), terms, N.edit_similarity, _first, least=0.6)
    rows = unknown.join(near.select(F.col("token").alias("tok"), F.col("identity").alias("term"), "similarity"), "tok")
    side = lambda g, name: pairs.select(F.col("gram").alias(g), F.col("n").alias(name))
    rows = rows.withColumns({"g1": F.concat("p", F.lit(" "), "term"), "g2": F.concat("term", F.lit(" "), "f")}).join(side("g1", "n1"), "g1", "left").join(side("g2", "n2"), "g2", "left")
    rows = rows.join(counts.select(F.col("tok").alias("term"), F.col("n").alias("n3")), "term", "left").join(F.broadcast(counts.agg(F.max("n").alias("most"))))  # one row
    log = lambda c: F.log1p(F.coalesce(c, F.lit(0)).cast("double"))
    rows = rows.withColumns({"before": log(F.col("n1")) / 8, "after": log(F.col("n2")) / 8, "common": log(F.col("n3")) / log(F.col("most"))})
    out = N.weighted_choice(rows, ["conv_id", "turn", "pos"], "term", REPAIR, 0.30, 0.035)
    return out.select("conv_id", "turn", "pos", "tok", "term", "score", "lead", "accepted")


_SENT = rf"s AS (SELECT doc_id, lang, unnest(string_split_regex(coalesce(text, ''), '[.!?؟\n]+')) AS sentence, unnest(range(len(string_split_regex(coalesce(text, ''), '[.!?؟\n]+')))) AS pos FROM documents), st AS (SELECT doc_id, lang, pos, regexp_extract_all(lower(sentence), '\p{{L}}+') AS w FROM s WHERE len(regexp_extract_all(lower(sentence), '\p{{L}}+')) BETWEEN 2 AND 160)"


@query(
    "phrase_examples",
    f"""WITH {_SENT}, b AS (SELECT {_TOKS} AS w FROM benchmark), k AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM b),
    g AS (SELECT DISTINCT doc_id, lang, pos, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase FROM st)
    SELECT lang, phrase, doc_id, CAST(pos AS INTEGER) AS pos, CAST(place AS INTEGER) AS place FROM (SELECT g.*, row_number() OVER (PARTITION BY lang, phrase ORDER BY doc_id, pos) AS place FROM g JOIN k USING (phrase)) WHERE place <= 3""",
)
def phrase_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.operators import corpus

    rows = corpus.sentences(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"))
    rows = rows.select("doc_id", "lang", "pos", T.tokens(F.col("sentence")).alias("toks"))
    words = table(spark, sf_dir, "benchmark").select(T.tokens(F.col("text")).alias("toks")).filter(F.size("toks") >= 2)
    phrases = words.select(F.explode(N.windows_of(F.col("toks"), F.lit(2), F.lit(2))).alias("phrase")).distinct()
    return retrieval.phrase_examples(rows, phrases, ["lang"], ["doc_id", "pos"], 2, 3)


@query(
    "quota_retrieval",
    rf"""WITH d AS (SELECT doc_id AS id, lang, source, {_TOKS} AS toks FROM documents), p AS (SELECT id, lang, source, tok, dl, count(*) AS tf FROM (SELECT id, lang, source, len(toks) AS dl, unnest(toks) AS tok FROM d) GROUP BY ALL),
    s AS (SELECT count(*) AS nd, avg(dl) AS ad FROM (SELECT DISTINCT id, dl FROM p)), f AS (SELECT tok, count(*) AS df FROM p GROUP BY tok), b AS (SELECT unnest({_TOKS}) AS tok FROM benchmark),
    q AS (SELECT tok, row_number() OVER (ORDER BY round(count(*) / (1 + ln(1 + any_value(df))), 6) DESC, tok) AS nr FROM b JOIN f USING (tok) GROUP BY tok QUALIFY nr <= 8),
    x AS (SELECT p.*, round(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / ad)), 4) AS score FROM p JOIN q USING (tok) JOIN f USING (tok), s WHERE dl BETWEEN 5 AND 4096),
    one AS (SELECT id, lang, source, score FROM x QUALIFY row_number() OVER (PARTITION BY tok, lang ORDER BY score DESC, id) <= CASE WHEN lang = 'en' THEN 12 ELSE 5 END),
    two AS (SELECT a.id, a.lang, a.source, round(a.score + b.score, 4) AS score FROM x a JOIN x b ON a.id = b.id AND a.tok < b.tok QUALIFY row_number() OVER (PARTITION BY a.tok, b.tok ORDER BY round(a.score + b.score, 4) DESC, a.id) <= 6),
    u AS (SELECT id, any_value(lang) AS lang, any_value(source) AS source, max(score) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY id)
    SELECT id, lang, source, score FROM u QUALIFY row_number() OVER (PARTITION BY source ORDER BY score DESC, id) <= 24""",
)
def quota_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for the eight strongest words of the benchmark, by word and by pair, with quotas by language and source."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "source", T.tokens(F.col("text")).alias("toks"))
    asked = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("tok"))
    index = stored(retrieval.postings(docs, ["lang", "source"]))
    strength = F.round(F.col("n") / (1 + F.log1p(F.col("df").cast("double"))), 6)
    counts = asked.groupBy("tok").agg(F.count(F.lit(1)).alias("n")).join(retrieval.frequencies(index), "tok")
    words = counts.orderBy(F.desc(strength), "tok").limit(8).select("tok")  # the strongest are the feature
    return retrieval.with_quotas(index, words, "lang", {"en": 12}, 5, 6, "source", 24, (5, 4096))


@query(
    "phrase_window_support",
    f"""WITH t AS (SELECT p_type, p_brand AS family, regexp_extract_all(lower(p_name || ' ' || p_type), '\\p{{L}}+') AS w FROM part), k AS (SELECT DISTINCT lower(p_name) AS phrase FROM part), e AS (SELECT DISTINCT p_type, family, w FROM t),
    n AS (SELECT p_type, family, w, unnest(range(1, least(7, 2 + 2) + 1)) AS n FROM e), x AS (SELECT DISTINCT p_type, family, unnest(list_transform(range(1, greatest(len(w) - n + 2, 1)), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS win FROM n),
    d AS (SELECT DISTINCT win FROM x), p AS (SELECT phrase, win, {sim("phrase", "win")} AS s FROM k JOIN d ON length(win) BETWEEN ceil(length(phrase) * 0.72) AND floor(length(phrase) / 0.72)),
    f AS (SELECT p_type, phrase, family, max(s) AS best FROM x JOIN p USING (win) WHERE s >= 0.72 GROUP BY ALL) SELECT p_type, phrase, count(*) AS families, round(max(best), 6) AS similarity, count(*) >= 2 AS supported FROM f GROUP BY ALL""",
)
def phrase_window_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    texts = part.select("p_type", F.col("p_brand").alias("family"), T.tokens(F.concat("p_name", F.lit(" "), "p_type")).alias("toks")).distinct()
    out = N.phrase_support(part.select(F.lower("p_name").alias("phrase")), texts, ["p_type"], N.edit_similarity)
    return out.withColumn("similarity", F.round("similarity", 6))


@query(
    "best_aliases",
    f"""WITH h AS (SELECT DISTINCT translate(p_name, 'aeiou', '') AS heard FROM part), l AS (SELECT DISTINCT p_name AS alias, split_part(p_name, ' ', 2) AS identity FROM part),
    p AS (SELECT heard, identity, alias, round({sim("heard", "alias")}, 6) AS s FROM h JOIN l ON length(alias) BETWEEN ceil(length(heard) * 0.55) AND floor(length(heard) * 1.65)),
    b AS (SELECT heard, identity, min(struct_pack(s := -s, alias := alias)) AS x FROM p WHERE s >= 0.50 GROUP BY ALL), r AS (SELECT heard, identity, x.alias AS alias, -x.s AS similarity FROM b),
    o AS (SELECT *, row_number() OVER w AS rank, similarity - coalesce(lead(similarity) OVER w, 0) AS lead FROM r WINDOW w AS (PARTITION BY heard ORDER BY similarity DESC, identity))
    SELECT heard, identity, alias, similarity, CAST(rank AS INTEGER) AS rank, rank = 1 AND (heard = alias OR similarity >= 0.74 AND round(lead, 6) >= 0.055) AS accepted FROM o WHERE rank <= 4""",
)
def best_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    heard = names.select(F.translate("p_name", "aeiou", "").alias("heard")).distinct()
    return N.best_aliases(heard, names.select(F.col("p_name").alias("alias"), F.element_at(F.split("p_name", " "), 2).alias("identity")), N.edit_similarity)


@query(
    "unsupported_fuzzy",
    f"""WITH c AS (SELECT DISTINCT conv_id, unnest({_TOKS}) AS tok FROM conversations WHERE role = 'assistant'), u AS (SELECT DISTINCT conv_id, unnest({_TOKS}) AS tok FROM conversations WHERE role <> 'assistant'),
    r AS (SELECT * FROM c EXCEPT SELECT * FROM u), n AS (SELECT DISTINCT r.conv_id, r.tok FROM r JOIN u ON u.conv_id = r.conv_id AND {sim("r.tok", "u.tok")} >= 0.72) SELECT * FROM r EXCEPT SELECT * FROM n""",
)
def unsupported_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = said(spark, sf_dir)
    return N.unsupported_fuzzy(rows.filter("role = 'assistant'"), rows.filter("role <> 'assistant'"), ["conv_id"], N.edit_similarity)


@query(
    "unknown_words_near_cues",
    f"""WITH {_SAID}, v AS (SELECT DISTINCT unnest({_TOKS}) AS tok FROM documents), n AS (SELECT *, bool_or(tok IN ('that', 'que', 'der')) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING) AS cued FROM w)
    SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, tok, CASE WHEN ends_with(tok, 'ing') AND length(tok) >= 7 THEN tok[1:-4] WHEN ends_with(tok, 's') AND length(tok) >= 5 THEN tok[1:-2] ELSE tok END AS stem FROM n ANTI JOIN v USING (tok) WHERE cued""",
)
def unknown_words_near_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("tok")).distinct()
    rows = N.near_cues(said(spark, sf_dir).drop("role"), ["conv_id", "turn"], F.col("tok").isin("that", "que", "der")).filter("cued")
    return rows.join(known, "tok", "left_anti").select("conv_id", "turn", "pos", "tok", N.without_suffix(F.col("tok"), ["ing", "s"]).alias("stem"))
