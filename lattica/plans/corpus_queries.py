"""Corpus building, n-grams, deduplication and text profiles over documents, conversations and the name tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import text as T
from lattica.operators import corpus, grounding
from lattica.plans.registry import query, table

_TOKS = r"regexp_extract_all(lower({0}), '\p{{L}}+')"
_DISTINCT = f"d AS (SELECT lang AS domain, {_TOKS.format('text')} AS toks, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING len(toks) > 0)"


def _grams(n: int, name: str = "g") -> str:
    return f"{name} AS (SELECT domain, gram, count(*) AS n_count FROM (SELECT domain, unnest(list_transform(range(1, greatest(len(toks) - {n} + 2, 1)), lambda i: array_to_string(toks[i : i + {n} - 1], ' '))) AS gram FROM d) GROUP BY domain, gram)"


def _windows(n: int, name: str) -> str:
    words = ", ".join(f"split_part(gram, ' ', {k}) AS w{k}" for k in range(1, n + 1))
    return f"{_grams(n, name + 'g')}, {name} AS (SELECT domain, {words}, n_count FROM {name}g)"


def _distinct(spark, sf_dir):  # noqa: ANN001, ANN202
    return corpus.distinct_tokens(table(spark, sf_dir, "documents"), "lang", "doc_id")


for _n, _name in ((1, "unigram"), (2, "bigram"), (3, "trigram")):
    query(f"ngram_{_name}", f"WITH {_DISTINCT}, {_grams(_n)} SELECT domain, gram, CAST(n_count AS BIGINT) AS n_count FROM g")(lambda spark, sf_dir, n=_n: corpus.ngrams(_distinct(spark, sf_dir), n))


@query(
    "ngram_weighted_union",
    rf"""WITH u AS (SELECT lang AS domain, text, 3 AS weight FROM documents UNION ALL SELECT role AS domain, text, 1 AS weight FROM conversations),
    t AS (SELECT domain, weight, unnest({_TOKS.format("text")}) AS gram FROM u WHERE text IS NOT NULL) SELECT domain, gram, CAST(sum(weight) AS BIGINT) AS n_count FROM t GROUP BY domain, gram""",
)
def ngram_weighted_union(spark, sf_dir):  # noqa: ANN001, ANN201
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("domain"), "text")
    talk = table(spark, sf_dir, "conversations").select(F.col("role").alias("domain"), "text")
    rows = corpus.union_sources([(docs, "documents", 3), (talk, "conversations", 1)])
    return corpus.ngrams(rows.select("domain", "weight", T.tokens(F.col("text")).alias("toks")), 1, F.col("weight"))


@query("corpus_source_stats", rf"SELECT source, count(*) AS n_docs, count(DISTINCT text) AS n_unique, CAST(sum(len({_TOKS.format('text')})) AS BIGINT) AS n_tokens FROM documents GROUP BY source")
def corpus_source_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("key"), F.size(T.tokens(F.col("text"))).alias("n"))
    each = rows.groupBy("source", "key").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n"))
    return each.groupBy("source").agg(F.sum("docs").alias("n_docs"), F.count("key").alias("n_unique"), F.sum("n").alias("n_tokens"))


@query(
    "sentence_segments",
    rf"""WITH p AS (SELECT doc_id, string_split_regex(text, '[.!?؟\n]+') AS s FROM documents),
    e AS (SELECT doc_id, unnest(s) AS sentence, unnest(range(len(s))) AS pos FROM p)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(len({_TOKS.format("sentence")}) AS INTEGER) AS n_tokens FROM e WHERE len({_TOKS.format("sentence")}) BETWEEN 2 AND 160""",
)
def sentence_segments(spark, sf_dir):  # noqa: ANN001, ANN201
    return corpus.sentences(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pos", "n_tokens")


@query(
    "topk_continuations",
    f"""WITH {_DISTINCT}, {_windows(2, "b")},
    r AS (SELECT *, row_number() OVER (PARTITION BY domain, w1 ORDER BY n_count DESC, w2) AS rank, sum(n_count) OVER (PARTITION BY domain, w1) AS total FROM b)
    SELECT domain, w1, w2, CAST(n_count AS BIGINT) AS n_count, CAST(rank AS INTEGER) AS rank, CAST(total AS BIGINT) AS total FROM r WHERE rank <= 24""",
)
def topk_continuations(spark, sf_dir):  # noqa: ANN001, ANN201
    return corpus.continuations(corpus.of_order(corpus.ngram_table(_distinct(spark, sf_dir), [2]), 2))


@query(
    "interpolated_next_word",
    f"""WITH {_DISTINCT}, {_windows(1, "u")}, {_windows(2, "b")}, {_windows(3, "t")},
    x AS (SELECT t.domain, t.w1, t.w2, t.w3, t.n_count AS c3, tt.n AS tn, b.n_count AS c2, bt.n AS bn, u.n_count AS c1, ut.n AS un FROM t
      JOIN (SELECT domain, w1, w2, sum(n_count) AS n FROM t GROUP BY ALL) tt ON t.domain = tt.domain AND t.w1 = tt.w1 AND t.w2 = tt.w2
      JOIN b ON b.domain = t.domain AND b.w1 = t.w2 AND b.w2 = t.w3 JOIN (SELECT domain, w1, sum(n_count) AS n FROM b GROUP BY ALL) bt ON bt.domain = t.domain AND bt.w1 = t.w2
      JOIN u ON u.domain = t.domain AND u.w1 = t.w3 JOIN (SELECT domain, sum(n_count) AS n FROM u GROUP BY ALL) ut ON ut.domain = t.domain),
    y AS (SELECT *, tn / (tn + 6.0) AS l3, (1 - tn / (tn + 6.0)) * bn / (bn + 18.0) AS l2 FROM x)
    SELECT domain, w1, w2, w3, round(CAST(l3 * c3 / tn + l2 * c2 / bn + (1 - l3 - l2) * c1 / un AS DOUBLE), 6) AS p FROM y""",
)
def interpolated_next_word(spark, sf_dir):  # noqa: ANN001, ANN201
    table_of = corpus.ngram_table(_distinct(spark, sf_dir))
    return corpus.interpolated(*(corpus.of_order(table_of, n) for n in (1, 2, 3)))


@query(
    "transition_quality",
    rf"""WITH d AS (SELECT 'all' AS domain, conv_id, turn, {_TOKS.format("text")} AS toks FROM conversations WHERE text IS NOT NULL), {_windows(2, "b")},
    best AS (SELECT w1, max(n_count) AS best FROM b GROUP BY w1),
    s AS (SELECT conv_id * 1000 + turn AS id, unnest(list_transform(range(1, len(toks)), lambda i: [toks[i], toks[i + 1]])) AS p FROM d),
    q AS (SELECT id, 100 * sqrt(n_count / best) AS q FROM s JOIN b ON b.w1 = p[1] AND b.w2 = p[2] JOIN best ON best.w1 = p[1])
    SELECT id, count(*) AS n_steps, round(0.70 * avg(q) + 0.30 * list_sort(list(q))[CAST(floor((count(*) - 1) * 0.25) AS BIGINT) + 1], 4) AS quality FROM q GROUP BY id""",
)
def transition_quality(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "conversations").select(F.lit("all").alias("domain"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.tokens(F.col("text")).alias("toks"))
    return corpus.transition_quality(rows, corpus.windows(rows, 2))


@query(
    "exact_dedup_first_wins",
    "SELECT lang, doc_id, source, n_group FROM (SELECT *, count(*) OVER w AS n_group, row_number() OVER (w ORDER BY doc_id) AS r FROM documents WINDOW w AS (PARTITION BY lang, text)) WHERE r = 1",
)
def exact_dedup_first_wins(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "documents").select("lang", "doc_id", "source", F.sha2("text", 256).alias("key"))
    return corpus.first_wins(rows, [F.col("lang"), F.col("key")], ["doc_id"]).select("lang", "doc_id", "source", "n_group")


_NAMES = "SELECT lower(p_name) AS key, p_type AS category, 0 AS pr, p_partkey AS pos, 'part' AS origin FROM part UNION ALL SELECT lower(s_name), 'supplier', 1, s_suppkey, 'supplier' FROM supplier UNION ALL SELECT lower(n_name), 'nation', 2, n_nationkey, 'nation' FROM nation"
# A supplier or nation is a term of its own category; a part that repeats a name within its type counts once.


@query("provenance_merge", f"SELECT key, category, origin, n_group FROM (SELECT *, count(*) OVER (PARTITION BY key, category) AS n_group, row_number() OVER (PARTITION BY key, category ORDER BY pr, pos) AS r FROM ({_NAMES})) WHERE r = 1 AND key <> ''")
def provenance_merge(spark, sf_dir):  # noqa: ANN001, ANN201
    part = table(spark, sf_dir, "part").select(F.lower("p_name").alias("key"), F.col("p_type").alias("category"), F.lit(0).alias("pr"), F.col("p_partkey").alias("pos"), F.lit("part").alias("origin"))
    supplier = table(spark, sf_dir, "supplier").select(F.lower("s_name"), F.lit("supplier"), F.lit(1), F.col("s_suppkey"), F.lit("supplier"))
    nation = table(spark, sf_dir, "nation").select(F.lower("n_name"), F.lit("nation"), F.lit(2), F.col("n_nationkey").cast("long"), F.lit("nation"))
    rows = corpus.first_wins(part.union(supplier).union(nation), [F.col("key"), F.col("category")], ["pr", "pos"])
    return rows.filter("key <> ''").select("key", "category", "origin", "n_group")


@query(
    "reject_reason_counts",
    r"""SELECT CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN NOT regexp_matches(text, '\p{L}') THEN 'no letters' WHEN len(regexp_extract_all(lower(text), '\p{L}+')) < 2 THEN 'one word'
    WHEN length(text) > 20000 THEN 'too long' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'noise' ELSE 'accepted' END AS reason, count(*) AS n FROM documents GROUP BY 1""",
)
def reject_reason_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    text = F.col("text")
    checks = {"empty": text.isNull() | (F.trim(text) == ""), "no letters": ~text.rlike(r"\p{L}"), "one word": F.size(T.tokens(text)) < 2, "too long": F.char_length(text) > 20000, "noise": text.rlike("[#$%&*]{3}")}
    return table(spark, sf_dir, "documents").select(F.coalesce(grounding.first_reason(checks), F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "script_profile",
    r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS latin, len(regexp_extract_all(coalesce(text, ''), '\p{L}')) AS letters FROM documents)
    SELECT doc_id, latin AS n_latin, letters - latin AS n_other, CASE WHEN letters = 0 THEN 1.0 ELSE round(latin / letters, 6) END AS ratio, letters >= 12 AND letters - latin >= 8 AND latin / letters < 0.5 AS foreign_script FROM c""",
)
def script_profile(spark, sf_dir):  # noqa: ANN001, ANN201
    latin, other = T.script_counts(F.coalesce(F.col("text"), F.lit("")))
    rows = table(spark, sf_dir, "documents").select("doc_id", latin.alias("n_latin"), other.alias("n_other"))
    letters = F.col("n_latin") + F.col("n_other")
    ratio = F.when(letters == 0, 1.0).otherwise(F.col("n_latin") / F.nullif(letters, F.lit(0)))
    return rows.select("doc_id", "n_latin", "n_other", F.round(ratio, 6).alias("ratio"), ((letters >= 12) & (F.col("n_other") >= 8) & (ratio < 0.5)).alias("foreign_script"))


@query(
    "degenerate_texts",
    rf"""WITH t AS (SELECT doc_id AS id, {_TOKS.format("text")} AS toks FROM documents WHERE text IS NOT NULL),
    e AS (SELECT id, unnest(toks) AS tok, unnest(range(len(toks))) AS pos FROM t),
    c AS (SELECT id, sum(n) AS n_tokens, max(n) AS top, count(*) AS different FROM (SELECT id, tok, count(*) AS n FROM e GROUP BY ALL) GROUP BY id),
    i AS (SELECT id, tok, pos - row_number() OVER (PARTITION BY id, tok ORDER BY pos) AS island FROM e), r AS (SELECT id, max(n) AS longest_run FROM (SELECT id, tok, island, count(*) AS n FROM i GROUP BY ALL) GROUP BY id)
    SELECT id, CAST(n_tokens AS BIGINT) AS n_tokens, round(top / n_tokens, 6) AS top_share, round(different / n_tokens, 6) AS distinct_share, longest_run,
    n_tokens >= 30 AND (top / n_tokens > 0.20 OR different / n_tokens < 0.24 OR longest_run >= 8) AS degenerate FROM c JOIN r USING (id)""",
)
def degenerate_texts(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = corpus.token_profile(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("toks")))
    return rows.withColumns({c: F.round(c, 6) for c in ("top_share", "distinct_share")})


@query(
    "phonetic_key_groups",
    """WITH n AS (SELECT p_name AS name FROM part UNION SELECT s_name FROM supplier), m AS (SELECT translate(lower(name), 'bvdgjzkqy', 'pftccscci') AS k FROM n)
    SELECT k[1:1] || regexp_replace(k[2:], '[aeiou]', '', 'g') AS key, count(*) AS n FROM m GROUP BY 1""",
)
def phonetic_key_groups(spark, sf_dir):  # noqa: ANN001, ANN201
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "supplier").select("s_name")).distinct()
    return names.groupBy(T.latin_key(F.col("name")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "regex_entity_extract",
    r"""SELECT doc_id, len(regexp_extract_all(text, 'https?://[^\s<>"]+')) AS n_urls, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) AS n_mails, len(regexp_extract_all(text, '[0-9]+')) AS n_numbers,
    regexp_extract(text, '[0-9]+') AS first_number FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)""",
)
def regex_entity_extract(spark, sf_dir):  # noqa: ANN001, ANN201
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("long")
    rows = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.select("doc_id", count(r'https?://[^\s<>"]+').alias("n_urls"), count(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").alias("n_mails"), count("[0-9]+").alias("n_numbers"), F.regexp_extract("text", "[0-9]+", 0).alias("first_number"))


@query("json_shape", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type || ':' || coalesce(json_extract_string(props, '$.k'), '') AS tag FROM events")
def json_shape(spark, sf_dir):  # noqa: ANN001, ANN201
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.cast("long").alias("k"), F.concat("event_type", F.lit(":"), F.coalesce(k, F.lit(""))).alias("tag"))
