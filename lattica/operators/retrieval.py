"""Retrieval: inverted index, BM25, pair queries, anchors and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.shared import stored

# The published Okapi constants.
K1, B = 1.2, 0.75


def postings(rows: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """(id, tok, tf, dl, and ``extra`` columns) from (id, toks, ...)."""
    extra = extra or []
    each = rows.select("id", *extra, F.size("toks").alias("dl"), F.explode("toks").alias("tok"))
    return each.groupBy("id", "tok", "dl", *extra).agg(F.count(F.lit(1)).alias("tf"))


def frequencies(index: DataFrame) -> DataFrame:
    """(tok, df): how many documents have a token."""
    return index.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))


def statistics(index: DataFrame) -> DataFrame:
    """One row: n_docs and avg_dl of the documents that have tokens. A document counts by one of its postings' shares, so no document is looked for twice."""
    each = index.agg(F.sum(F.col("tf") / F.col("dl")).alias("n"), F.sum("tf").alias("words"))
    return each.select(F.round("n").cast("long").alias("n_docs"), (F.col("words") / F.round("n")).alias("avg_dl"))


def okapi(df: Column, tf: Column, dl: Column, n_docs: Column, avg_dl: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avg_dl))


def scored_postings(index: DataFrame, words: DataFrame) -> DataFrame:
    """``index`` of the ``words`` (tok, ...) with the Okapi score of each posting."""
    known = words.join(frequencies(index), "tok").join(F.broadcast(statistics(index)))  # one row of statistics
    score = okapi(F.col("df"), F.col("tf"), F.col("dl"), F.col("n_docs"), F.col("avg_dl"))
    return index.join(known, "tok").withColumn("score", score).drop("df", "n_docs", "avg_dl")


def bm25(index: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """Best ``keep`` documents (query, id, score, rank) of each query of (query, tok); ties by id. Scores are rounded to 4 places before ranking."""
    out = scored_postings(index, queries.distinct()).groupBy("query", "id").agg(F.round(F.sum("score"), 4).alias("score"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def with_quotas(index: DataFrame, words: DataFrame, domain: str, quotas: dict[str, int], quota: int, each_pair: int, source: str, each_source: int, lengths: tuple[int, int]) -> DataFrame:
    """(id, domain, source, score): the best of each word and domain (``quotas``, else ``quota``), the best ``each_pair`` of each pair of words, each document with its best score, and of those the best of each source.

    ``words`` (tok) are few: pairs are of postings of one document. Only documents of so many tokens count.
    """
    scored = stored(scored_postings(index, words).filter(F.col("dl").between(*lengths)).withColumn("score", F.round("score", 4)))
    most = F.lit(quota)
    for name, n in quotas.items():
        most = F.when(F.col(domain) == name, n).otherwise(most)
    best = lambda df, keys: df.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id")))
    out = ["id", domain, source, "score"]
    one = best(scored, ["tok", domain]).filter(F.col("__place") <= most).select(*out)
    other = scored.select("id", F.col("tok").alias("with"), F.col("score").alias("more"))
    pairs = scored.join(other, "id").filter("tok < with").withColumn("score", F.round(F.col("score") + F.col("more"), 4))
    two = best(pairs, ["tok", "with"]).filter(F.col("__place") <= each_pair).select(*out)
    found = one.unionByName(two).groupBy("id", domain, source).agg(F.max("score").alias("score"))
    return best(found, [source]).filter(F.col("__place") <= each_source).select(*out)


def phrase_examples(rows: DataFrame, phrases: DataFrame, keys: list[str], order: list[str], n: int, keep: int) -> DataFrame:
    """(keys, phrase, order, place): the first ``keep`` rows of (keys, order, toks) in each key that hold a phrase of ``n`` words of (phrase)."""
    at = F.sequence(F.lit(1), F.size("toks") - n + 1)
    grams = F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(F.col("toks"), i, n), " ")))
    found = rows.filter(F.size("toks") >= n).select(*keys, *order, F.explode(grams).alias("phrase")).join(phrases, "phrase")
    place = F.row_number().over(Window.partitionBy(*keys, "phrase").orderBy(*order))
    return found.withColumn("place", place).filter(F.col("place") <= keep).select(*keys, "phrase", *order, "place")


def pair_hits(index: DataFrame, pairs: DataFrame, keep: int = 6) -> DataFrame:
    """(a, b, id, score, place): the best ``keep`` documents that hold both words of a pair (a, b), by the sum of their scores; ties by id.

    The rarer word of a pair brings its documents, the other one is looked up in those by document and word, so that a word that is
    everywhere is never listed for each of its pairs.
    """
    words = pairs.select(F.explode(F.array("a", "b")).alias("tok")).distinct()
    scored = stored(scored_postings(index, words).select("id", "tok", F.round("score", 4).alias("score")))
    df = frequencies(scored)
    of = lambda x: df.select(F.col("tok").alias(x), F.col("df").alias(f"{x}_df"))
    rarer = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("first", F.col("a_df") <= F.col("b_df"))
    rarer = rarer.select("a", "b", F.when(F.col("first"), F.col("a")).otherwise(F.col("b")).alias("tok"), F.when(F.col("first"), F.col("b")).otherwise(F.col("a")).alias("__other"))
    one = rarer.join(scored, "tok").select("a", "b", "__other", "id", F.col("score").alias("__score"))
    both = one.join(scored.select("id", F.col("tok").alias("__other"), "score"), ["id", "__other"]).withColumn("score", F.round(F.col("score") + F.col("__score"), 4))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc("score"), "id"))
    return both.withColumn("place", place).filter(F.col("place") <= keep).select("a", "b", "id", "score", "place")


def anchors(each: DataFrame, counts: DataFrame) -> DataFrame:
    """(tok, families, occurrences, corpus_count, score) of tokens of (family, tok) that the corpus counts know."""
    found = each.groupBy("tok").agg(F.countDistinct("family").alias("families"), F.count(F.lit(1)).alias("occurrences"))
    rows = found.join(counts, "tok").filter("corpus_count > 0")
    rarity = 1.0 / (1.0 + F.log1p("corpus_count"))
    return rows.withColumn("score", F.round(2.2 * F.col("families") + 0.22 * F.least(F.lit(6), F.col("occurrences")) + rarity, 6))


def centroids(vectors: DataFrame, family: str = "label", vector: str = "embedding") -> DataFrame:
    """The mean vector of each family, scaled to length 1: (family, centroid)."""
    parts = vectors.select(F.col(family).alias("family"), F.posexplode(vector).alias("at", "x"))
    means = parts.groupBy("family", "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))  # as many as dimensions
    v = F.transform("v", lambda s: s["x"])
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
    return rows.select("family", F.transform(v, lambda x: x / length).alias("centroid"))
