"""Writers: subtitles, partitioned tables and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import clock


def subtitle(number: Column, start: Column, end: Column, text: Column, vtt: bool = False) -> Column:
    """One cue of an SRT or VTT file."""
    mark = "." if vtt else ","
    head = F.lit("") if vtt else F.concat(number.cast("string"), F.lit("\n"))
    return F.concat(head, clock(start, mark), F.lit(" --> "), clock(end, mark), F.lit("\n"), F.trim(text), F.lit("\n"))


def write_partitioned(df: DataFrame, path: str, columns: list[str]) -> None:
    """Parquet by partition columns; the job commits as a whole."""
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """The latest row of each key of both tables; at the same time the new one."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(at), F.desc("__new"))
    return both.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank", "__new")


def _rename(spark: SparkSession, source: str, target: str) -> None:
    """Puts a finished folder in place of another: the old one goes only when the new one is whole."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = path(target + ".old")
    fs.delete(old, True)
    if fs.exists(path(target)) and not fs.rename(path(target), old):
        raise OSError(f"cannot move {target} away")
    if not fs.rename(path(source), path(target)):
        raise OSError(f"cannot move {source} to {target}")
    fs.delete(old, True)


def build_corpus(rows: DataFrame, path: str, version: int, orders: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Builds a corpus folder of (domain, source, text, weight): sentences (also as gzip lines of JSON), n-grams, sources and a manifest; returns the sources.

    Sentences of a domain with the same words count once, by their first source. All is written beside ``path`` and moved there when it is whole.
    """
    from lattica.functions.text import tokens
    from lattica.operators import corpus

    spark, building = rows.sparkSession, path.rstrip("/") + ".building"
    cut = corpus.sentences(rows).select("domain", "source", "weight", F.trim("sentence").alias("text"), F.array_join(tokens(F.col("sentence")), " ").alias("normalized"))
    first = cut.groupBy("domain", F.md5("normalized").alias("key")).agg(F.min(F.struct("source", "text", "normalized", "weight")).alias("s")).select("domain", "s.*")
    first.write.mode("overwrite").partitionBy("domain").parquet(f"{building}/sentences")
    kept = spark.read.parquet(f"{building}/sentences")
    kept.write.mode("overwrite").option("compression", "gzip").json(f"{building}/lines")
    counted = [corpus.ngrams(kept.select("domain", "weight", F.split("normalized", " ").alias("toks")), n, F.col("weight")).withColumn("n", F.lit(n)) for n in orders]
    for k, part in enumerate(counted):
        part.write.mode("overwrite" if k == 0 else "append").partitionBy("n").parquet(f"{building}/ngrams")
    kept.groupBy("domain", "source").agg(F.count(F.lit(1)).alias("unique_sentences"), F.sum(F.size(F.split("normalized", " "))).alias("n_tokens")).write.mode("overwrite").parquet(f"{building}/sources")
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{building}/manifest.json")
    _rename(spark, building, path.rstrip("/"))
    return spark.read.parquet(f"{path.rstrip('/')}/sources")


def comparison(results: DataFrame, path: str) -> None:
    """A CSV with a header and a byte order mark for spreadsheets, one row a hypothesis, in the order of its name: a report."""
    named = results.select(*(F.col(c) for c in results.columns))
    first = named.columns[0]
    named.withColumnRenamed(first, "﻿" + first).coalesce(1).sortWithinPartitions("﻿" + first).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def write_transcripts(segments: DataFrame, path: str) -> None:
    """TXT, SRT, VTT and JSON lines of (run, start, end, text), in a folder for each run: cues in order, numbered from 1; a run of blank texts has empty files."""
    order = Window.partitionBy("run").orderBy("start", "end", "text")
    rows = segments.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("number", F.row_number().over(order))
    number = F.col("number")
    cues = {
        "srt": subtitle(number, F.col("start"), F.col("end"), F.col("text")),
        "vtt": F.concat(F.when(number == 1, "WEBVTT\n\n").otherwise(""), subtitle(number, F.col("start"), F.col("end"), F.col("text"), True)),
        "txt": F.trim("text"), "json": F.to_json(F.struct("number", "start", "end", "text")),
    }
    for kind, cue in cues.items():
        out = rows.select("run", "number", cue.alias("value")).repartition("run").sortWithinPartitions("run", "number").select("run", "value")
        out.write.mode("overwrite").partitionBy("run").text(f"{path}/{kind}")


def write_results(decided: DataFrame, path: str, key: list[str], verdict: str = "verdict") -> DataFrame:
    """Tables final (accepted and kept), review and scorecard below ``path``, and one row of summary measures, which is returned."""
    decided.filter(F.col(verdict) != "REVIEW").write.mode("overwrite").parquet(f"{path}/final")
    decided.filter(F.col(verdict) == "REVIEW").write.mode("overwrite").parquet(f"{path}/review")
    decided.groupBy(*key, verdict).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/scorecard")
    measures = decided.agg(F.count(F.lit(1)).alias("slots"), *(F.count_if(F.col(verdict) == v).alias(v.lower()) for v in ("ACCEPT", "REVIEW", "REJECT", "KEEP_SOURCE")))
    measures.write.mode("overwrite").parquet(f"{path}/summary")
    return decided.sparkSession.read.parquet(f"{path}/summary")


def write_lexicon(terms: DataFrame, counters: DataFrame, path: str) -> DataFrame:
    """Tables terms, counters (of the build) and categories (term counts) below ``path``; returns the categories."""
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    counters.write.mode("overwrite").parquet(f"{path}/counters")
    terms.groupBy("category").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/categories")
    return terms.sparkSession.read.parquet(f"{path}/categories")


def clip_plan(intervals: DataFrame, most: int, padding: float) -> DataFrame:
    """(key, number, start, end): which intervals of each key an audio tool has to cut, in order, ``most`` at most (a report)."""
    order = Window.partitionBy("key").orderBy("start", "end")
    return intervals.withColumn("number", F.row_number().over(order)).filter(F.col("number") <= most).select("key", "number", F.greatest(F.lit(0.0), F.col("start") - padding).alias("start"), (F.col("end") + padding).alias("end"))
