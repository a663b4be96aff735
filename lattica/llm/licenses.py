"""License scans by ordered signature rules, with DataFrame functions only.

A text is lower-cased and cut into words. A substring test of a few stems decides whether a rule can apply at all; then each rule
whose keyword is among the words is matched, and of detections of which one contains the other that of higher priority stays.
Every row is looked at by itself: nothing is shuffled.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.license_rules import STEMS, rules
from lattica.llm.shared import table

#: Phrases counted in every text, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_RULE = "struct<rule: int, label: string, priority: int, keyword: string, pattern: string>"
_SPAN = "struct<start: int, stop: int, priority: int, rule: int, label: string>"


def lower_ascii(text: Column) -> Column:
    """Lower case in which no other letter becomes one of a-z; words outside ASCII may change theirs, never into ASCII ones.

    The Kelvin sign is the one character whose lower case is an ASCII letter; the dotted capital I keeps its dot.
    """
    return F.lower(F.when(text.contains("\u212a"), F.replace(text, F.lit("\u212a"), F.lit("\u0138"))).otherwise(text))


def _spans(padded: Column, rule: Column) -> Column:
    """All places where the rule matches: what lies between the matches gives their offsets.

    Offsets are added up in two levels, over and within runs of about the root of the number of matches, since an array grows by copying.
    """
    between, found = F.split(padded, rule["pattern"], -1), F.regexp_extract_all(padded, rule["pattern"], F.lit(0))
    pairs = F.filter(F.arrays_zip(between.alias("between"), found.alias("found")), lambda p: p["found"].isNotNull())
    sizes = F.transform(pairs, lambda p: F.struct(F.char_length(p["between"]).alias("before"), F.char_length(p["found"]).alias("own")))
    width = F.ceil(F.sqrt(F.size(found))).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / width).cast("int")), lambda k: F.slice(sizes, k * width + 1, width))
    none = F.array().cast(f"array<{_SPAN}>")

    def begin(acc: Column, run: Column) -> Column:
        length = F.aggregate(run, F.lit(0), lambda n, p: n + p["before"] + p["own"])
        return F.struct((acc["at"] + length).alias("at"), F.concat(acc["begins"], F.array(acc["at"])).alias("begins"))

    def add(acc: Column, p: Column) -> Column:
        first = acc["at"] + p["before"]
        stop = first + p["own"]
        span = F.struct(first.alias("start"), stop.alias("stop"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"))
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    begins = F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("begins")), begin, lambda acc: acc["begins"])
    spans = F.flatten(F.transform(F.arrays_zip(runs.alias("run"), begins.alias("at")), lambda r: F.aggregate(r["run"], F.struct(r["at"].alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])))
    return F.when(F.size(found) > 0, spans).otherwise(none)


def _kept(spans: Column) -> Column:
    """Labels and best priority of spans that no other span suppresses, in one sweep from left to right.

    ``active`` are the spans that reach beyond the present start; only those can contain it.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), (-s["priority"]).alias("low"), s["rule"].alias("rule"), s["label"].alias("label"))))
    kind = "array<struct<start: int, back: int, low: int, rule: int, label: string>>"
    begin = F.struct(F.array().cast(kind).alias("active"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"))

    def step(acc: Column, s: Column) -> Column:
        active = F.filter(acc["active"], lambda b: -b["back"] > s["start"])
        longer = lambda b: (b["start"] < s["start"]) | (b["back"] < s["back"])
        beaten = F.exists(active, lambda b: (b["back"] <= s["back"]) & ((b["low"] < s["low"]) | (b["low"] == s["low"]) & (longer(b) | (b["rule"] < s["rule"]))))
        return F.struct(
            F.concat(active, F.array(s)).alias("active"),
            F.when(beaten, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(s["label"]))).alias("labels"),
            F.when(beaten, acc["best"]).otherwise(F.greatest(acc["best"], -s["low"])).alias("best"),
        )

    return F.aggregate(order, begin, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["best"].alias("best")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score.

    Words: runs of digits, letters (A-Z as a-z) and characters outside ASCII. Base phrases are counted wherever their words
    stand one after another. score: 1 with a base phrase, else the highest confidence of a kept detection, 0 with none.
    Null and empty texts have no words and no labels.
    """
    known = rules()
    table_of_rules = F.from_json(F.lit(json.dumps(known)), f"array<{_RULE}>")
    keywords = sorted({r["keyword"] for r in known})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    out = out.select("doc_id", F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")).cast("long").alias("n_words"), lower_ascii(F.col("text")).alias("low"))
    may = reduce(Column.__or__, (F.col("low").contains(s) for s in STEMS))
    out = out.select("doc_id", "n_words", F.when(may, F.concat(F.lit(" "), F.trim(F.regexp_replace("low", r"[^0-9a-z\x{80}-\x{10FFFF}]+", " ")), F.lit(" "))).alias("padded"))
    padded = F.col("padded")
    counts = [F.coalesce(F.regexp_count(padded, F.lit(f"(?<= ){p}(?= )")), F.lit(0)) for p in BASE]
    spaces = lambda c: F.char_length(c) - F.char_length(F.replace(c, F.lit(" "), F.lit("")))
    firsts = [F.when(n > 0, spaces(F.substring_index(padded, f" {p} ", 1))) for p, n in zip(BASE, counts, strict=True)]
    lasts = [F.when(n > 0, F.col("n_words") - spaces(F.substring_index(padded, f" {p} ", -1)) - len(p.split())) for p, n in zip(BASE, counts, strict=True)]
    base = F.array_compact(F.array(*(F.when(n > 0, F.lit(name)) for (_, name), n in zip(BASE.items(), counts, strict=True))))
    has = F.array_distinct(F.regexp_extract_all(padded, F.lit(f"(?<= )({'|'.join(keywords)})(?= )"), F.lit(1)))
    out = out.select("doc_id", "n_words", "padded", sum(counts).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"), F.array_sort(base).alias("base"), F.when(padded.isNotNull(), has).alias("has"))
    chosen = F.filter(table_of_rules, lambda r: F.array_contains(F.col("has"), r["keyword"]))
    out = out.withColumn("chosen", F.when(F.size("has") > 0, chosen)).withColumn("spans", F.when(F.col("chosen").isNotNull(), F.flatten(F.transform("chosen", lambda r: _spans(padded, r)))))
    out = out.withColumn("kept", F.when(F.size("spans") > 0, _kept(F.col("spans"))))
    labels = F.array_sort(F.array_union("base", F.coalesce(F.col("kept.labels"), F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.col("kept.best") / 100.0, F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
