"""Lexicon and fuzzy joins, retrieval, vectors, alignment, decoding and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import similarity as S
from lattica.functions import text as T
from lattica.operators import fuzzy, grounding, lattice, retrieval
from lattica.operators.shared import stored
from lattica.plans.registry import query, table

_TOKS = r"regexp_extract_all(lower(coalesce(text, '')), '\p{L}+')"
_DOCS = rf"d AS (SELECT doc_id AS id, {_TOKS} AS toks FROM documents), b AS (SELECT item_id, {_TOKS} AS words FROM benchmark)"
_INDEX = "p AS (SELECT id, tok, dl, count(*) AS tf FROM (SELECT id, len(toks) AS dl, unnest(toks) AS tok FROM d) GROUP BY id, tok, dl)"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.tokens(F.col("text")).alias("toks"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.tokens(F.col("text")).alias("words"))


@query("lexicon_semijoin", f"WITH {_DOCS}, l AS (SELECT DISTINCT unnest(words) AS tok FROM b), e AS (SELECT id, unnest(toks) AS tok FROM d) SELECT id, count(*) AS n_known FROM e WHERE tok IN (SELECT tok FROM l) GROUP BY id")
def lexicon_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = items(spark, sf_dir).select(F.explode("words").alias("tok")).distinct()
    return documents(spark, sf_dir).select("id", F.explode("toks").alias("tok")).join(lexicon, "tok", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_known"))


@query(
    "phrase_match",
    f"""WITH {_DOCS}, k AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(len(words) - 2, 1)), lambda i: array_to_string(words[i : i + 3], ' '))) AS phrase FROM b WHERE len(words) >= 4), g AS (SELECT id, unnest(list_transform(range(1, greatest(len(toks) - 2, 1)), lambda i: array_to_string(toks[i : i + 3], ' '))) AS phrase FROM d)
    SELECT id, phrase, count(*) AS places FROM g JOIN k USING (phrase) GROUP BY id, phrase""",
)
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    four = items(spark, sf_dir).filter(F.size("words") >= 4).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - 3), lambda i: F.slice(F.col("words"), i, 4))).alias("words"))
    phrases = four.distinct()
    return fuzzy.phrase_matches(documents(spark, sf_dir), phrases)


_TERMS = "t AS (SELECT DISTINCT p_name AS term, p_brand AS brand FROM part)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.col("p_brand").alias("brand"))


@query(
    "fuzzy_join_blocked",
    f"""WITH {_TERMS}, p AS (SELECT a.term, b.term AS match, a.brand, 1 - levenshtein(a.term, b.term) / greatest(length(a.term), length(b.term)) AS sim FROM t a JOIN t b ON a.brand = b.brand AND a.term[1:1] = b.term[1:1] AND abs(length(a.term) - length(b.term)) <= 2 AND a.term <> b.term)
    SELECT term, match, brand, round(sim, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY term, brand ORDER BY sim DESC, match) AS rank FROM p WHERE sim >= 0.5) WHERE rank <= 4""",
)
def fuzzy_join_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, first = _parts(spark, sf_dir), lambda c: F.substring(c, 1, 1)
    near = lambda a, b: 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b))
    return fuzzy.blocked_join(rows, rows, first, near, 2, 0.5, 4, ["brand"]).withColumn("similarity", F.round("similarity", 6))


@query("fuzzy_join_indel")
def fuzzy_join_indel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _parts(spark, sf_dir)
    return fuzzy.blocked_join(rows, rows, lambda c: F.substring(T.latin_key(c), 1, 1), S.indel_ratio, 2, 0.60, 4, ["brand"])


_BM = "round(sum(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / ad))), 4)"


@query(
    "bm25_topk",
    f"""WITH {_DOCS}, {_INDEX}, s AS (SELECT count(*) AS nd, avg(dl) AS ad FROM (SELECT DISTINCT id, dl FROM p)), f AS (SELECT tok, count(*) AS df FROM p GROUP BY tok), q AS (SELECT DISTINCT item_id AS query, unnest(words) AS tok FROM b),
    x AS (SELECT query, id, {_BM} AS score FROM p JOIN q USING (tok) JOIN f USING (tok), s GROUP BY query, id)
    SELECT query, id, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 5""",
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = items(spark, sf_dir).select(F.col("item_id").alias("query"), F.explode("words").alias("tok"))
    return retrieval.bm25(stored(retrieval.postings(documents(spark, sf_dir))), asked, 5)


@query(
    "pair_and_retrieval",
    f"""WITH {_DOCS}, x AS (SELECT DISTINCT a, b FROM (SELECT unnest(words[1:-2]) AS a, unnest(words[2:]) AS b FROM b WHERE len(words) >= 2) WHERE a <> b), w AS (SELECT a AS tok FROM x UNION SELECT b FROM x),
    e AS (SELECT id, len(toks) AS dl, unnest(toks) AS tok FROM d WHERE len(toks) > 0), s AS (SELECT count(*) AS nd, avg(len(toks)) AS ad FROM d WHERE len(toks) > 0),
    p AS (SELECT id, tok, dl, count(*) AS tf FROM e WHERE tok IN (SELECT tok FROM w) GROUP BY ALL), f AS (SELECT tok, count(*) AS df FROM p GROUP BY tok),
    z AS (SELECT id, tok, round(ln(1 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / ad)), 4) AS score FROM p JOIN f USING (tok), s)
    SELECT a, b, id, score, CAST(place AS INTEGER) AS place FROM (SELECT x.a, x.b, m.id, round(m.score + n.score, 4) AS score, row_number() OVER (PARTITION BY x.a, x.b ORDER BY round(m.score + n.score, 4) DESC, m.id) AS place
    FROM x JOIN z m ON m.tok = x.a JOIN z n ON n.tok = x.b AND n.id = m.id) WHERE place <= 6""",
)
def pair_and_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents of every pair of words that stand side by side in the benchmark."""
    rows = items(spark, sf_dir).filter(F.size("words") >= 2)
    pair = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.struct(F.element_at("words", i).alias("a"), F.element_at("words", i + 1).alias("b")))
    pairs = rows.select(F.inline(pair)).filter("a <> b").distinct()
    return retrieval.pair_hits(stored(retrieval.postings(documents(spark, sf_dir))), pairs)


@query(
    "anchor_ranking",
    rf"""WITH e AS (SELECT role AS family, unnest({_TOKS}) AS tok FROM conversations), c AS (SELECT tok, count(*) AS corpus_count FROM (SELECT unnest({_TOKS}) AS tok FROM documents) GROUP BY tok),
    f AS (SELECT tok, count(DISTINCT family) AS families, count(*) AS occurrences FROM e GROUP BY tok)
    SELECT tok, families, occurrences, corpus_count, round(CAST(2.2 * families + 0.22 * least(6, occurrences) + 1.0 / (1.0 + ln(1 + corpus_count)) AS DOUBLE), 6) AS score FROM f JOIN c USING (tok)""",
)
def anchor_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "conversations").select(F.col("role").alias("family"), F.explode(T.tokens(F.col("text"))).alias("tok"))
    counts = documents(spark, sf_dir).select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("corpus_count"))
    return retrieval.anchors(each, counts)


_CENTROIDS = """m AS (SELECT label AS family, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL),
c AS (SELECT family, list(x ORDER BY i) AS v FROM m GROUP BY family)"""


@query("centroid_similarity", f"WITH {_CENTROIDS} SELECT e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v), 5) AS similarity FROM embeddings e JOIN c ON c.family = e.label")
def centroid_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    known = retrieval.centroids(rows).withColumnRenamed("family", "label")
    return rows.join(known, "label").select("vec_id", "label", F.round(S.cosine(F.col("embedding"), F.col("centroid")), 5).alias("similarity"))


@query(
    "top3_mean_similarity",
    f"""WITH {_CENTROIDS}, s AS (SELECT e.vec_id, c.family, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), c.v) AS x FROM embeddings e, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, family) AS rank FROM s) SELECT vec_id, round(avg(x), 5) AS mean3, round(max(x), 5) AS best FROM r WHERE rank <= 3 GROUP BY vec_id""",
)
def top3_mean_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    # One row holds the centroid of every family, of which there are few.
    known = retrieval.centroids(rows).agg(F.collect_list("centroid").alias("centroids"))
    scored = rows.join(F.broadcast(known)).select("vec_id", F.reverse(F.array_sort(F.transform("centroids", lambda c: S.cosine(F.col("embedding"), c)))).alias("x"))
    top = F.slice("x", 1, 3)
    return scored.select("vec_id", F.round(F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top), 5).alias("mean3"), F.round(F.element_at("x", 1), 5).alias("best"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn, with all its words, as one reading of its conversation: words of 0.4 seconds, shifted a little by turn."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(T.tokens(F.col("text"))).alias("pos", "word"))
    start = F.col("pos") * 0.4 + F.col("turn") * 0.05
    return rows.select(F.col("conv_id").alias("run"), "turn", F.concat(F.lit("h"), F.col("turn").cast("string")).alias("hypothesis"), F.col("role").alias("family"), "word", start.alias("start"), (start + 0.35).alias("end"), F.lit(0.9).alias("probability"))


@query("align_network")
def align_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.align_network(_words(spark, sf_dir), ["h0", "h1", "h2"])


@query("align_pair")
def align_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn that has words with the next that has, named by the former's number."""
    words = _words(spark, sf_dir)
    before = F.lag("turn").over(Window.partitionBy("run").orderBy("turn"))
    follows = words.select("run", "turn").distinct().select("run", "turn", before.alias("before")).filter("before IS NOT NULL")
    other = words.join(follows, ["run", "turn"]).withColumn("turn", F.col("before")).drop("before")
    return lattice.align_pair(words, other, ["run", "turn"])


def _candidates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Candidates of each slot with what speaks for them, and what each word pair that follows in a reading gains.

    A reading has one word in a slot at most, so rows are readings.
    """
    words = _words(spark, sf_dir)
    slots = stored(lattice.align_network(words, ["h0", "h1", "h2"]))
    of = slots.groupBy("run", "slot").agg(F.count(F.lit(1)).alias("readings"))
    found = slots.groupBy("run", "slot", F.col("word").alias("candidate")).agg(F.countDistinct("family").alias("families"), F.max("probability").alias("probability"), F.count(F.lit(1)).alias("sources"))
    nothing = F.when(F.col("readings") >= 3, 0.25).when(F.col("readings") == 2, 2.35).otherwise(6.20)
    empty = of.select("run", "slot", F.lit("").alias("candidate"), nothing.alias("nothing"))
    after = F.lead("word").over(Window.partitionBy("run", "turn").orderBy("start"))
    pairs = words.select("run", F.col("word").alias("left"), after.alias("right")).filter("right IS NOT NULL").groupBy("run", "left", "right").agg(F.count(F.lit(1)).alias("n"))
    return found.unionByName(empty, allowMissingColumns=True), pairs.select("run", "left", "right", F.log1p(F.col("n").cast("double")).alias("gain"))


@query("beam_decode")
def beam_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, pairs = _candidates(spark, sf_dir)
    return lattice.decode(lattice.scored(rows, {"families": 2.2, "probability": 0.42, "nothing": 1.0}), pairs)


@query("beam_decode_components")
def beam_decode_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lattice with the weights of the phrase decoder, and its width."""
    rows, pairs = _candidates(spark, sf_dir)
    rows = rows.withColumn("sources", F.least(F.lit(6), "sources"))
    return lattice.decode(lattice.scored(rows, {"families": 0.52 * 2.2 + 0.55, "probability": 0.52 * 0.42, "sources": 0.08, "nothing": 0.52}), pairs.withColumn("gain", 0.72 * F.col("gain")), 96)


@query("repair_loop")
def repair_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = rows.select("conv_id", "turn", "role", F.col("text").alias("claim"), before.alias("evidence")).filter("role = 'assistant'")
    return grounding.repair(pairs.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "claim", "evidence"))
