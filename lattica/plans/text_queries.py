"""Texts for display, numbers as words, names protected, unknown words marked, and phrase sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import similarity as S
from lattica.functions import text as T
from lattica.operators import grounding
from lattica.plans.name_queries import _SAID, _TOKS, key, said
from lattica.plans.registry import query, table


@query("displayed_texts", r"SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\s]+', ' ', 'g'), ' ([.,;:!?])', '\1', 'g'), ' ')) AS shown_sha256 FROM documents")
def displayed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.displayed(F.coalesce("text", F.lit(""))), 256).alias("shown_sha256"))


@query("token_runs", "WITH r AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[0-9]+|[A-Za-z]+') AS r FROM documents) SELECT doc_id, CAST(len(r) AS INTEGER) AS n_runs, array_to_string(r[greatest(1, len(r) - 4) :], ' ') AS tail FROM r")
def token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.runs(F.col("text")).alias("r"))
    return rows.select("doc_id", F.size("r").alias("n_runs"), T.last_joined(F.col("r"), 5).alias("tail"))


_WORDS = {"ones": T._ONES, "tens": T._TENS, "hundreds": T._HUNDREDS}
_LISTS = ", ".join(f"[{', '.join(repr(w) for w in words)}] AS {name}" for name, words in _WORDS.items())


@query(
    "number_words",
    f"""WITH c AS (SELECT {_LISTS}), v AS (SELECT o_orderkey, o_orderkey % 10000 AS v FROM orders), p AS (SELECT o_orderkey, v, v // 1000 AS t, (v % 1000) // 100 AS h, v % 100 AS r FROM v)
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN t = 1 THEN 'هزار' WHEN t > 1 THEN ones[t + 1] || ' هزار' END, CASE WHEN h > 0 THEN hundreds[h] END, CASE WHEN r >= 20 THEN tens[r // 10 - 1] END,
    CASE WHEN r > 0 AND r < 20 THEN ones[r + 1] WHEN r >= 20 AND r % 10 > 0 THEN ones[r % 10 + 1] WHEN v = 0 THEN ones[1] END], lambda x: x IS NOT NULL), ' و ') AS words FROM p, c""",
)
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", T.number_words_column(F.pmod(F.col("o_orderkey"), F.lit(10000))).alias("words"))


@query(
    "protected_names",
    """WITH t AS (SELECT c_custkey, 'Dear ' || c_name || ' of ' || n_name || ', yours ' || c_name AS text FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, 'Dear [NAME 1] of [NAME 2], yours [NAME 3]' AS shown, array_to_string(regexp_extract_all(text, '(?:Customer#[0-9]+|NATION_[0-9]+)'), '|') AS names, text AS restored FROM t""",
)
def protected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    text = F.concat(F.lit("Dear "), "c_name", F.lit(" of "), "n_name", F.lit(", yours "), "c_name")
    rows = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", T.protected(text, "Customer#[0-9]+|NATION_[0-9]+").alias("p"))
    return rows.select("c_custkey", F.col("p.text").alias("shown"), F.array_join("p.names", "|").alias("names"), T.filled(F.col("p.text"), F.col("p.names")).alias("restored"))


@query(
    "unknown_runs",
    f"""WITH {_SAID}, v AS (SELECT DISTINCT unnest({_TOKS}) AS tok FROM documents), k AS (SELECT w.conv_id, w.turn, w.pos, CASE WHEN v.tok IS NULL THEN '[?]' ELSE w.tok END AS shown FROM w LEFT JOIN v USING (tok)),
    b AS (SELECT *, lag(shown) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS p FROM k) SELECT conv_id, turn, count(*) FILTER (shown = '[?]') AS n_runs, sha256(string_agg(shown, ' ' ORDER BY pos)) AS shown_sha256 FROM b WHERE p IS NULL OR shown <> '[?]' OR p <> '[?]' GROUP BY ALL""",
)
def unknown_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with one mark for each run of words that the documents don't have."""
    known = table(spark, sf_dir, "documents").select(F.explode(T.tokens(F.col("text"))).alias("tok")).distinct().withColumn("known", F.lit(True))
    rows = said(spark, sf_dir).join(known, "tok", "left").withColumn("shown", F.when(F.col("known"), F.col("tok")).otherwise("[?]"))
    first = F.lag("shown").over(Window.partitionBy("conv_id", "turn").orderBy("pos"))
    kept = rows.withColumn("p", first).filter("p IS NULL OR shown <> '[?]' OR p <> '[?]'")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]), " ")  # the words of one turn
    return kept.groupBy("conv_id", "turn").agg(F.count_if(F.col("shown") == "[?]").alias("n_runs"), F.sha2(text, 256).alias("shown_sha256"))


@query("number_units", "WITH m AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[0-9]+ [a-z]+')) AS m FROM documents) SELECT doc_id, split_part(m, ' ', 1) AS number, split_part(m, ' ', 2) AS unit, count(*) AS n FROM m GROUP BY ALL")
def number_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]+ [a-z]+"), F.lit(0))).alias("m"))
    parts = F.split("m", " ")
    return rows.groupBy("doc_id", F.get(parts, F.lit(0)).alias("number"), F.get(parts, F.lit(1)).alias("unit")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "rendered_turns",
    f"""WITH {_SAID}, b AS (SELECT *, lag(tok) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS p FROM w)
    SELECT conv_id, turn, sha256(string_agg(CASE WHEN p IS NULL THEN '' WHEN p IN ('re', 'in') OR tok IN ('er', 'en', 'ing') THEN chr(8204) ELSE ' ' END || tok, '' ORDER BY pos)) AS text_sha256 FROM b GROUP BY ALL""",
)
def rendered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("toks")).filter(F.size("toks") > 0)
    return rows.select("conv_id", "turn", F.sha2(T.rendered(F.col("toks"), ["re", "in"], ["er", "en", "ing"]), 256).alias("text_sha256"))


_TWO = "list_transform(range(1, greatest(len(w) - {0} + 2, 1)), lambda i: array_to_string(w[i : i + {0} - 1], ' '))"


@query(
    "lexicon_phrase_sets",
    f"""WITH b AS (SELECT {_TOKS} AS w FROM benchmark), g AS (SELECT DISTINCT unnest({_TWO.format(2)}) AS gram FROM b UNION SELECT DISTINCT unnest({_TWO.format(3)}) FROM b)
    SELECT gram, array_to_string(list_transform(string_split(gram, ' '), lambda x: {key("x")}), ' ') AS key FROM g""",
)
def lexicon_phrase_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lattica.operators.names import windows_of

    rows = table(spark, sf_dir, "benchmark").select(T.tokens(F.col("text")).alias("toks"))
    grams = rows.select(F.explode(windows_of(F.col("toks"), F.lit(2), F.lit(3))).alias("gram")).distinct()
    return grams.select("gram", F.array_join(F.transform(F.split("gram", " "), T.latin_key), " ").alias("key"))


@query("phonetic_keys")
def phonetic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both keys of every name, after composition and normalising."""
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), T.normalised(T.nfkc("n_name"), "spaced").alias("plain"))
    return rows.select("name", T.phonetic_key(F.col("plain")).alias("key"), T.skeleton(F.col("plain")).alias("skeleton"))


@query("composite_similarity")
def composite_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of one kind and length class, compared by spelling, by key and by their last word."""
    rows = table(spark, sf_dir, "part").select("p_type", "p_name").distinct()
    pairs = rows.alias("a").join(rows.alias("b"), F.expr("a.p_type = b.p_type AND a.p_name < b.p_name AND substring(a.p_name, 1, 1) = substring(b.p_name, 1, 1)")).select("a.p_type", F.col("a.p_name").alias("a"), F.col("b.p_name").alias("b"))
    last = lambda c: F.element_at(F.split(c, " "), -1)
    return pairs.select("p_type", "a", "b", F.round(S.composite(F.col("a"), F.col("b"), T.latin_key, last("a") == last("b")), 6).alias("similarity"))


@query("phrase_collapse")
def phrase_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with repeated words and phrases said once."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("toks"))
    return grounding.collapsed(rows, ["conv_id", "turn"])
