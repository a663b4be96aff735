"""Readers with explicit schemas: hypotheses, delimited and JSON sources, archives, line lists and lexicons."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<start: double, end: double, word: string, probability: double>"
HYPOTHESIS = (
    "run_id string, model string, source string, device string, compute_type string, requested_language string, detected_language string, detected_language_probability double, "
    "duration double, text string, warning string, segments array<struct<id: int, seek: int, start: double, end: double, text: string, tokens: array<int>, temperature: double, "
    f"avg_logprob: double, compression_ratio: double, no_speech_prob: double, words: array<{WORD}>>>"
)
TERM = "term string, category string, english string, source string, license string"


def hypotheses(spark: SparkSession, path: str, expected: list[str] | None = None) -> DataFrame:
    """One row per JSON file with its key model__source. Raises if an ``expected`` key is missing or there twice."""
    rows = spark.read.schema(HYPOTHESIS).option("multiLine", True).json(path).withColumn("hypothesis", F.concat_ws("__", "model", "source"))
    if expected:
        wanted = spark.createDataFrame([(k,) for k in expected], "hypothesis string")
        wrong = wanted.join(rows.groupBy("hypothesis").count(), "hypothesis", "left").filter("count IS NULL OR count <> 1").collect()  # as many as expected at most
        if wrong:
            raise ValueError(f"missing or repeated hypotheses: {sorted(r[0] for r in wrong)}")
    return rows


def word_observations(rows: DataFrame) -> DataFrame:
    """One row per spoken word, numbered within its hypothesis after words without letters or digits are dropped."""
    each = rows.select("run_id", "hypothesis", F.col("model").alias("family"), "source", F.posexplode("segments").alias("seg", "s"))
    each = each.select("run_id", "hypothesis", "family", "source", "seg", F.col("s.avg_logprob").alias("avg_logprob"), F.posexplode("s.words").alias("pos", "w"))
    each = each.select("run_id", "hypothesis", "family", "source", "seg", "pos", "avg_logprob", "w.*").withColumn("normalized", F.regexp_replace(F.lower("word"), r"[^\p{L}\p{N}]+", "")).filter("normalized <> ''")
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("run_id", "hypothesis").orderBy("seg", "pos")) - 1
    return each.withColumn("id", F.concat_ws(":", "hypothesis", number.cast("string"))).drop("seg", "pos")


def shifted(rows: DataFrame, offset: str) -> DataFrame:
    """Hypotheses whose segments and words count time from a clip's begin, moved to that of the recording by the column ``offset``; segments are numbered anew."""
    word = lambda w: w.withField("start", w["start"] + F.col(offset)).withField("end", w["end"] + F.col(offset))
    moved = F.transform("segments", lambda s, k: word(s).withField("id", k).withField("words", F.transform(s["words"], word)))
    return rows.withColumn("segments", moved).drop(offset)


def delimited(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("encoding", encoding).csv(path)


def pipe_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of lines cut at the first pipe; the header, which names ``text``, is left out."""
    lines = spark.read.text(path)
    return lines.filter(F.col("value").contains("|") & ~F.lower("value").rlike(r"\|text\s*$")).select(F.substring_index("value", "|", 1).alias("name"), F.expr("substring(value, instr(value, '|') + 1)").alias("text"))


def json_lexicon(spark: SparkSession, path: str, source: str, license_name: str) -> DataFrame:
    """The ``terms`` of a JSON lexicon, with source and licence where a term has none."""
    rows = spark.read.schema(f"terms array<struct<{TERM.replace(' string', ': string')}>>").option("multiLine", True).json(path)
    return rows.select(F.inline("terms")).withColumns({"source": F.coalesce("source", F.lit(source)), "license": F.coalesce("license", F.lit(license_name))})


def zipped_json_lines(spark: SparkSession, path: str, member: str, field: str) -> DataFrame:
    """``text``: a field of the JSON lines in those members of ZIP archives whose name holds ``member``; bad lines are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as archive:
                    for name in archive.namelist():
                        if member in name:
                            found = []
                            for line in archive.open(name):
                                try:
                                    value = json.loads(line)
                                except ValueError:
                                    continue
                                if isinstance(value, dict) and isinstance(value.get(field), str):
                                    found.append(value[field])
                            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["text"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "text string")


def term_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lines that are not empty and do not begin with #."""
    return spark.read.text(path).select(F.trim("value").alias("term")).filter("term <> '' AND NOT startswith(term, '#')").distinct()


def latest_result(df: DataFrame, run: str, version: str, precedence: list[str], newest: str | None = None) -> DataFrame:
    """Of each run the row of the version that comes first in ``precedence``, and of those the newest; unknown versions come last, by name."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, precedence)), F.col(version)), F.lit(0)), F.lit(len(precedence) + 1))
    latest = [(-F.col(newest)).alias("n")] if newest else []
    best = df.groupBy(run).agg(F.min(F.struct(place.alias("p"), F.col(version).alias("v"), *latest, F.struct(*df.columns).alias("row"))).alias("b"))
    return best.select("b.row.*")
