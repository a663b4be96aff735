"""Sources of terms and texts with rejects, eligibility, caches and checks: spreadsheets, splits with literal answers, corpus folders."""

from __future__ import annotations

import ast
import io
import json
import re
import time
import zipfile
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from lattica.functions.text import name_key, tokens
from lattica.operators.grounding import first_reason

# Attempts of a fetch and bounds in seconds of the wait that a busy server asks for; weights of questions and answers.
ATTEMPTS, SHORTEST_WAIT, LONGEST_WAIT = 5, 1.0, 12.0
QUESTION, ANSWER = 3, 2


def sheet_rows(content: bytes) -> Iterator[list[str]]:
    """The rows of the active sheet of a workbook as texts; empty cells are ''."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        local = lambda e: e.tag.rsplit("}", 1)[-1]
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = ["".join(t.text or "" for t in s.iter() if local(t) == "t") for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if local(s) == "si"]
        sheets = sorted((n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        active = 0
        if "xl/workbook.xml" in book.namelist():
            active = next((int(v.get("activeTab", 0)) for v in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if local(v) == "workbookView"), 0)
        if not sheets:
            return
        for row in (e for e in ElementTree.fromstring(book.read(sheets[min(active, len(sheets) - 1)])).iter() if local(e) == "row"):
            cells: dict[int, str] = {}
            for k, cell in enumerate(c for c in row if local(c) == "c"):
                letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
                at = sum((ord(x) - 64) * 26**p for p, x in enumerate(reversed(letters))) - 1 if letters else k
                text = "".join(t.text or "" for t in cell.iter() if local(t) in ("v", "t"))
                cells[at] = shared[int(text)] if cell.get("t") == "s" and text.isdigit() and int(text) < len(shared) else text
            yield [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]


def spreadsheet_terms(spark: SparkSession, path: str) -> DataFrame:
    """file, row, term, english, category of the workbooks at ``path`` that have a column term_fa; a category that is empty is the file's name without its ending.

    Each workbook is read whole by one task; sheets are of a size that people edit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                file, out, at = name.rsplit("/", 1)[-1], [], None
                for k, row in enumerate(sheet_rows(content.as_py())):
                    if at is None:
                        at = {h.strip(): i for i, h in enumerate(row)}
                        if "term_fa" not in at:
                            break
                        continue
                    cell = lambda h, row=row, at=at: row[at[h]].strip() if h in at and at[h] < len(row) else ""
                    if cell("term_fa"):
                        out.append((file, k, cell("term_fa"), cell("term_en"), cell("term_type") or file.rsplit(".", 1)[0]))
                columns = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["file", "row", "term", "english", "category"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content").mapInArrow(run, "file string, row long, term string, english string, category string")


def first_terms(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first row, by file and row, of each normalised term, and how many rows each category had before that."""
    keyed = rows.withColumn("normalized", name_key(F.col("term"))).filter("normalized <> ''")
    best = keyed.groupBy("normalized").agg(F.min(F.struct("file", "row", "term", "english", "category")).alias("b")).select("normalized", "b.*")
    return best, rows.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def with_rejects(rows: DataFrame, checks: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """``rows`` that no check rejects, and (reject_reason, n): each row counts for the first check that holds, 'accepted' for none."""
    judged = rows.withColumn("reject_reason", first_reason(dict(checks)))
    counts = judged.groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("reject_reason")).agg(F.count(F.lit(1)).alias("n"))
    return judged.filter("reject_reason IS NULL").drop("reject_reason"), counts


@F.pandas_udf(ArrayType(StringType()))
def literal_values(answers: pd.Series) -> pd.Series:
    """The text values of dictionaries written as Python literals or JSON; none of what is neither."""

    def values(text: str | None) -> list[str]:
        for read in (ast.literal_eval, json.loads):
            try:
                found = read(text or "")
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
            if isinstance(found, dict):
                return [v for v in found.values() if isinstance(v, str)]
        return []

    return answers.map(values)


def question_rows(rows: DataFrame) -> DataFrame:
    """text and weight of (question, answer): questions weigh 3; each value of two words or more of an answer's dictionary weighs 2."""
    answers = rows.select(F.explode(literal_values("answer")).alias("text")).filter(F.size(tokens(F.col("text"))) >= 2)
    return rows.filter(F.trim(F.coalesce("question", F.lit(""))) != "").select(F.col("question").alias("text"), F.lit(QUESTION).alias("weight")).unionByName(answers.withColumn("weight", F.lit(ANSWER)))


def concept_list(spark: SparkSession, path: str) -> DataFrame:
    """(place, term, normalized): lines that are not empty and no comments, the first of each normalised form, in their order."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), F.trim("value").alias("term")).filter("term <> '' AND NOT startswith(term, '#')")
    keyed = rows.withColumn("normalized", name_key(F.col("term"))).filter("normalized <> ''")
    return keyed.groupBy("normalized").agg(F.min(F.struct("place", "term")).alias("b")).select("b.place", "b.term", "normalized")


def eligible(terms: DataFrame, categories: list[str], most: int, general: DataFrame | None = None, generic: list[str] | None = None) -> DataFrame:
    """Terms of some categories with at most ``most`` words, none of them ``generic``, and not all of them ``general`` (word)."""
    rows = terms.filter(F.col("category").isin(categories)).withColumn("words", F.split(name_key(F.col("term")), " ")).filter(F.size("words").between(1, most))
    if generic:
        rows = rows.filter(~F.arrays_overlap("words", F.array(*map(F.lit, generic))))
    if general is None:
        return rows.drop("words")
    each = rows.select("term", "category", F.explode("words").alias("word")).distinct()
    special = each.join(general.select("word").distinct(), "word", "left_anti").select("term", "category").distinct()
    return rows.drop("words").join(special, ["term", "category"], "left_semi")


def open_corpus(spark: SparkSession, path: str, tables: list[str], version: int) -> dict[str, DataFrame]:
    """The tables of a corpus folder by name. Raises if its manifest has another version, or if a table is missing or empty."""
    found = spark.read.schema("version int").json(f"{path.rstrip('/')}/manifest.json").first()
    if found is None or found[0] != version:
        raise ValueError(f"corpus of version {found and found[0]}, not {version}")
    out = {name: spark.read.parquet(f"{path.rstrip('/')}/{name}") for name in tables}
    if empty := [name for name, df in out.items() if df.isEmpty()]:
        raise ValueError(f"empty tables: {empty}")
    return out


def cache_misses(asked: DataFrame, cache: DataFrame, key: str, now: Column, days: float) -> DataFrame:
    """Distinct keys of ``asked`` that ``cache`` (key, fetched_at in seconds, ...) does not have, or only longer ago than so many days."""
    fresh = cache.filter(F.col("fetched_at") >= now - days * 86400).select(key).distinct()
    return asked.select(key).filter(F.col(key).isNotNull()).distinct().join(fresh, key, "left_anti")


class Busy(Exception):
    """Raised by a fetcher whose server is busy, with the seconds that it asks to wait."""

    def __init__(self, wait: float | None = None):
        super().__init__(wait)
        self.wait = wait


def fetched(missing: DataFrame, key: str, fetch: Callable[[str], str | None], now: float, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(key, value, fetched_at) for each row, by a function of the caller's; a busy server is asked five times, waiting 1 to 12 seconds, and what fails has no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k in pdf[key]:
                for _ in range(ATTEMPTS):
                    try:
                        value = fetch(k)
                    except Busy as busy:
                        sleep(min(LONGEST_WAIT, max(SHORTEST_WAIT, busy.wait or SHORTEST_WAIT)))
                        continue
                    except OSError:
                        break
                    if value is not None:
                        rows.append((k, value, now))
                    break
            yield pd.DataFrame(rows, columns=[key, "value", "fetched_at"])

    return missing.select(key).mapInPandas(run, f"{key} string, value string, fetched_at double")


def newest_first(runs: DataFrame, run: str) -> DataFrame:
    """``runs`` with ``place``, 1 for the newest by name: a listing of a catalogue, which is small."""
    return runs.withColumn("place", F.row_number().over(Window.orderBy(F.desc(run))))
