"""Claims against their evidence: mentions, signatures, validation codes, contradictions, repairs, retention and verdicts.

Claims and evidence meet by joins on their keys, so that no run's evidence is gathered into one row. Only what one claim itself holds
is put into an array.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Share of words and number of words below which a repaired text has lost too much; ordered coverage of a faithful one;
# length ratios of an acceptable change; words of a boundary that two neighbouring texts may share.
KEPT, FEWEST, COVERED = 0.45, 8, 0.68
SHORTEST, LONGEST, BOUNDARY = 0.55, 1.80, 3
MARK = "[?]"


def numbers(text: Column) -> Column:
    """The runs of digits of a text, in order of their characters, repeats included."""
    return F.array_sort(F.coalesce(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), F.array().cast("array<string>")))


def signature(text: Column, words: Mapping[str, list[str]]) -> Column:
    """What must not change: numbers and, for each named list, the words of it that the text has, all sorted and as one string."""
    toks = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))

    def listed(name: str) -> Column:
        return F.array_join(F.array_sort(F.filter(toks, lambda t: t.isin(words[name]))), ",")

    return F.concat_ws(";", F.array_join(numbers(text), ","), *map(listed, sorted(words)))


def mentions(rows: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """(keys, value, n, families, agreed): what the texts of (keys, family, text) mention; agreed where two families or more do."""
    each = rows.select(*keys, "family", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(0))).alias("value"))
    by = each.groupBy(*keys, "value", "family").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys, "value").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("families"))
    return by.withColumn("agreed", F.col("families") >= 2)


def consistent_sums(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, parts, total, stated): of numbers (keys, value: long, n) whether the largest is the sum, or the product of the number, of all others."""
    rows = found.groupBy(*keys).agg(F.sum("n").alias("parts"), F.sum(F.col("value") * F.col("n")).alias("total"), F.max("value").alias("stated"))
    return rows.withColumn("adds_up", (F.col("parts") > 2) & (F.col("total") == 2 * F.col("stated")))


def missing(claims: DataFrame, evidence: DataFrame, keys: list[str], at: list[str], what: Column) -> DataFrame:
    """(keys, at, part) of the distinct parts (an array column ``what`` of ``text``) of each claim that no evidence row of its keys has."""
    parts = lambda df, names: df.select(*names, F.explode(what).alias("part")).distinct()
    return parts(claims, [*keys, *at]).join(parts(evidence, keys), [*keys, "part"], "left_anti").select(*keys, *at, "part")


def held(rows: DataFrame, keys: list[str], patterns: Mapping[str, str]) -> DataFrame:
    """(keys and a boolean for each name): whether any text of a key matches a pattern."""
    return rows.groupBy(*keys).agg(*(F.max(F.coalesce(F.col("text").rlike(p), F.lit(False))).alias(name) for name, p in patterns.items()))


def contradictions(claims: DataFrame, evidence: DataFrame, keys: list[str], opposites: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``claims`` with ``contradictions``: the names of the opposites (one pattern, the other) of which a claim has one side and its evidence only the other."""
    sides = {f"__{name}_{k}": p for name, pair in opposites.items() for k, p in enumerate(pair)}
    rows = claims.join(held(evidence, keys, sides), keys, "left").fillna(False, list(sides))
    checks = []
    for name, pair in opposites.items():
        mine = [F.coalesce(F.col("text").rlike(p), F.lit(False)) for p in pair]
        its = [F.col(f"__{name}_{k}") for k in (0, 1)]
        checks.append(F.when((mine[0] & ~mine[1] & its[1] & ~its[0]) | (mine[1] & ~mine[0] & its[0] & ~its[1]), F.lit(name)))
    return rows.withColumn("contradictions", F.array_compact(F.array(*checks))).drop(*sides)


def codes(rows: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """``rows`` with ``codes``: the names of all checks that hold, in order."""
    return rows.withColumn("codes", F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()))))


def flagged(rows: DataFrame, found: DataFrame, by: list[str], name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: whether ``found`` has a row of the same ``by``."""
    return rows.join(found.select(*by).distinct().withColumn(name, F.lit(True)), by, "left").fillna(False, [name])


def sentences(text: Column) -> Column:
    """The sentences of a text with their end marks, without space around them; no empty ones."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: s != "")


def without_sentences(text: Column, having: Column) -> Column:
    """The text without the sentences that have one of the numbers in the array ``having``, joined by single spaces."""
    bad = lambda s: F.arrays_overlap(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)), having)
    return F.array_join(F.filter(sentences(text), lambda s: ~F.coalesce(bad(s), F.lit(False))), " ")


def redacted_words(text: Column, words: Column, mark: str = MARK) -> Column:
    """The text with a mark for each piece between spaces whose letters, in lower case, are one of ``words``; marks in a row become one."""
    letters = lambda p: F.lower(F.regexp_replace(p, r"[^\p{L}]+", ""))
    marked = F.array_join(F.transform(F.split(text, " "), lambda p: F.when(F.array_contains(words, letters(p)), F.lit(mark)).otherwise(p)), " ")
    quoted = mark.replace("[", r"\[").replace("]", r"\]").replace("?", r"\?")
    return F.regexp_replace(marked, f"{quoted}( {quoted})+", mark)


def retained(before: Column, after: Column) -> Column:
    """Whether a repaired text of ``after`` words keeps enough of ``before`` words."""
    return (after >= FEWEST) & (after >= KEPT * before)


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists, a machine word of rows at a time."""
    masks: dict[str, int] = {}
    for k, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << k
    state = full = (1 << len(a)) - 1
    for w in b:
        both = state & masks.get(w, 0)
        state = ((state + both) | (state - both)) & full
    return len(a) - state.bit_count()


@F.pandas_udf(DoubleType())
def ordered_coverage(reference: pd.Series, candidate: pd.Series) -> pd.Series:
    """Share of the words of ``reference`` that ``candidate`` has in the same order; 1 for no words."""
    return pd.Series([common_subsequence(list(a), list(b)) / len(a) if a is not None and len(a) else 1.0 for a, b in zip(reference, ([] if x is None else x for x in candidate), strict=True)])


def choice_reason(before: Column, after: Column, changed: Column, families: Column, noise_before: Column, noise_after: Column) -> Column:
    """Why a choice that turns a text of ``before`` characters into one of ``after`` is refused; null if it is not."""
    ratio = after / F.nullif(before, F.lit(0))
    return F.when(ratio.isNull() | ~ratio.between(SHORTEST, LONGEST), "length").when(noise_after > noise_before, "anomaly").when(changed & (families < 2), "sensitive")


def replaced_rows(raw: DataFrame, enhanced: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Rows of ``enhanced`` with ``values`` of the ``raw`` row of the same keys, and ``repaired``, where its own column ``bad`` is true, that of the raw row is not, and the first value of that isn't blank."""
    own = raw.select(*keys, F.col("bad").alias("__bad"), *(F.col(v).alias(f"__{v}") for v in values))
    rows = enhanced.join(own, keys, "left")
    swap = F.coalesce(F.col("bad") & ~F.col("__bad") & (F.trim(F.coalesce(F.col(f"__{values[0]}"), F.lit(""))) != ""), F.lit(False))
    return rows.select(*keys, *(F.when(swap, F.col(f"__{v}")).otherwise(F.col(v)).alias(v) for v in values), swap.alias("repaired"))


def stitched(segments: DataFrame, words: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(keys, segment, text) of (keys, segment, start, end, text, reviewed): a reviewed segment has the words (keys, at, word) inside of it, in order, or its own text if there are none."""
    spans = segments.filter("reviewed").select(*keys, "segment", "start", "end")
    right = spans.withColumn("__bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    inside = words.withColumn("__bucket", F.floor(F.col("at") / width)).join(right, [*keys, "__bucket"]).filter(F.col("at").between(F.col("start"), F.col("end")))
    said = inside.groupBy(*keys, "segment").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("said"))
    return segments.join(said, [*keys, "segment"], "left").select(*keys, "segment", F.coalesce(F.nullif(F.trim("said"), F.lit("")), "text").alias("text"), "reviewed")


def trimmed(left: Column, toks: Column, most: int = BOUNDARY) -> Column:
    """The words ``toks`` without the longest run of up to ``most`` words at their begin that the words ``left`` end with."""
    out = toks
    for n in range(1, most + 1):
        same = (F.size(left) >= n) & (F.size(toks) >= n) & (F.slice(left, F.greatest(F.lit(1), F.size(left) - n + 1), n) == F.slice(toks, 1, n))
        out = F.when(same, F.slice(toks, n + 1, F.greatest(F.lit(0), F.size(toks) - n))).otherwise(out)
    return out


def before(rows: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``before_x``, x of the row before, for each value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumns({f"before_{v}": F.lag(v).over(w) for v in values})


def first_text(own: Column, otherwise: Column) -> Column:
    """The own text if it is neither null nor blank, else the other, else an empty one."""
    return F.coalesce(F.when(F.trim(own) != "", own), otherwise, F.lit(""))


def recheck_verdict(free: Column, rival: Column, quality: Column) -> Column:
    """A targeted second look: what was heard freely and what of the rival, as similarities of 0 to 100, and the quality of the rival's text."""
    return F.when((free >= 65) & (rival >= 75), "CONFLICT").when(free >= 65, "CONFIRMED").when((rival >= 75) & quality, "REJECTED").otherwise("UNCLEAR")


def agreed_polarity(rows: DataFrame, keys: list[str], negations: list[str]) -> DataFrame:
    """(keys, negative, positive, polarity) of (keys, family, text): negative or positive where two families or more say so and more than say the opposite, else null."""
    toks = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    says = rows.groupBy(*keys, "family").agg(F.max(F.arrays_overlap(toks, F.array(*(F.lit(w) for w in negations)))).alias("no"))
    counts = says.groupBy(*keys).agg(F.count_if(F.col("no")).alias("negative"), F.count_if(~F.col("no")).alias("positive"))
    verdict = F.when((F.col("negative") >= 2) & (F.col("negative") > F.col("positive")), "negative").when((F.col("positive") >= 2) & (F.col("positive") > F.col("negative")), "positive")
    return counts.withColumn("polarity", verdict)
