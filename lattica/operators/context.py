"""What stands around a row and what many sources say of it: local evidence, vocabulary, neighbours, following rows, gates and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Occurrences a thousand million words as a logarithm from which a token is a common word; weights of the corpus bonus,
# caps of its logarithms and of its sum; bonus of a slot whose families agree; tokens a lead frame looks ahead.
COMMON_WORD = 3.25
CORPUS_WEIGHTS, CORPUS_CAPS, CORPUS_MOST = (0.020, 0.145, 0.235), (5.0, 5.0, 5.5), 0.18
UNANIMOUS, AHEAD = 1.50, 6
# Cue hits, term hits and the share of the special domain that either of them gives; the share without any.
DOMAIN_MIX, NO_DOMAIN = ((6, 12, 0.90), (2, 4, 0.76), (1, 1, 0.55)), 0.25


def local_evidence(rows: DataFrame, n: int, families: int = 2) -> DataFrame:
    """gram, n_count and n_families of the n-grams of (family, toks) that at least so many families have."""
    at = F.sequence(F.lit(1), F.size("toks") - n + 1)
    grams = F.explode(F.transform(at, lambda i: F.array_join(F.slice(F.col("toks"), i, n), " ")))
    each = rows.filter(F.size("toks") >= n).select("family", grams.alias("gram")).groupBy("family", "gram").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("gram").agg(F.sum("n").alias("n_count"), F.count(F.lit(1)).alias("n_families")).filter(F.col("n_families") >= families)


def vocabulary(toks: DataFrame) -> DataFrame:
    """tok, n_count, zipf (decimal logarithm of occurrences a thousand million tokens) and is_member of the tokens of ``toks`` (tok)."""
    counts = toks.groupBy("tok").agg(F.count(F.lit(1)).alias("n_count"))
    total = counts.agg(F.sum("n_count").alias("__total"))  # one row
    rows = counts.join(F.broadcast(total)).withColumn("zipf", F.log10(F.col("n_count") / F.col("__total") * 1e9))
    return rows.select("tok", "n_count", "zipf", (F.col("zipf") >= COMMON_WORD).alias("is_member"))


def active_words(known: DataFrame, allowed: DataFrame, blocked: DataFrame, stems: DataFrame | None = None, stem_zipf: float = 4.0) -> DataFrame:
    """(tok, why) of the words of a ``vocabulary`` that count as words: common ones, those of ``allowed`` (tok), and those whose stem in ``stems`` (tok, stem) is common enough; never one of ``blocked`` (tok)."""
    found = known.filter("is_member").select("tok", F.lit("common").alias("why")).unionByName(allowed.select("tok", F.lit("allowed").alias("why")))
    if stems is not None:
        strong = known.filter(F.col("zipf") >= stem_zipf).select(F.col("tok").alias("stem"))
        found = found.unionByName(stems.join(strong, "stem", "left_semi").select("tok", F.lit("stem").alias("why")))
    return found.groupBy("tok").agg(F.min("why").alias("why")).join(blocked.select("tok").distinct(), "tok", "left_anti")


def without_bridges(rows: DataFrame, keys: list[str], order: list[str], value: str, families: str, pairs: DataFrame) -> DataFrame:
    """``rows`` with ``rewritten``: null for a value that one family has, between two neighbours of several that are a pair of ``pairs`` (a, b)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    around = rows.withColumns({"__a": F.lag(value).over(w), "__b": F.lead(value).over(w), "__fa": F.lag(families).over(w), "__fb": F.lead(families).over(w)})
    known = pairs.select(F.col("a").alias("__a"), F.col("b").alias("__b")).distinct().withColumn("__known", F.lit(True))
    bridge = F.coalesce(F.col("__known") & (F.col(families) < 2) & (F.col("__fa") >= 2) & (F.col("__fb") >= 2), F.lit(False))
    return around.join(known, ["__a", "__b"], "left").withColumn("rewritten", F.when(~bridge, F.col(value))).drop("__a", "__b", "__fa", "__fb", "__known")


def pivoted(counts: DataFrame, key: str, domain: str, domains: list[str], value: str) -> DataFrame:
    """A row for each key with the sum of ``value`` in each named domain, 0 where it has none."""
    return counts.groupBy(key).pivot(domain, domains).agg(F.sum(value)).fillna(0, domains)


def domain_mix(cues: Column, terms: Column) -> Column:
    """The share of the special domain in a mix of two, from its cue and term hits."""
    out = F.lit(NO_DOMAIN)
    for cue, term, share in reversed(DOMAIN_MIX):
        out = F.when((cues >= cue) | (terms >= term), F.lit(share)).otherwise(out)
    return out


def lead_frame(rows: DataFrame, keys: list[str], order: list[str], value: str, ahead: int = AHEAD) -> DataFrame:
    """``rows`` with ``frame``: the values of the next ``ahead`` rows of the same keys, in order."""
    return rows.withColumn("frame", F.collect_list(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1, ahead)))


def first_following(rows: DataFrame, keys: list[str], order: list[str], found: Column, value: str) -> DataFrame:
    """``rows`` with ``following``: ``value`` of the first later row of the same keys where ``found`` holds, else null.

    Read from the end, so that each row costs one step and no frame is gone through again.
    """
    back = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("following", F.last(F.when(found, F.col(value)), ignorenulls=True).over(back))


def without_echoes(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """``rows`` with ``rewritten``: null where the rows before and after have the same value as the row itself."""
    w = Window.partitionBy(*keys).orderBy(*order)
    echo = (F.lag(value).over(w) == F.col(value)) & (F.lead(value).over(w) == F.col(value))
    return rows.withColumn("rewritten", F.when(F.coalesce(echo, F.lit(False)), F.lit(None)).otherwise(F.col(value)))


def prefix_overlaps(a: Column, b: Column, least: int = 3) -> Column:
    """Whether the shorter of two tokens of at least so many characters begins the longer one."""
    return (F.least(F.length(a), F.length(b)) >= least) & (F.startswith(a, b) | F.startswith(b, a))


def ordered_text(pairs: DataFrame, keys: list[str], order: list[str], value: str, by: str = " ") -> DataFrame:
    """keys, n and text: the values of each key's rows joined in the order given."""
    found = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__value"))))
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(found, lambda x: x["__value"]), by).alias("text"))


def alternatives(parts: dict[str, DataFrame]) -> DataFrame:
    """key, n and families (sorted) of the keys that the named parts (key) hold together."""
    rows = None
    for name, part in parts.items():
        one = part.groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("family", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.array_sort(F.collect_set("family")).alias("families"))


def vote_gate(scored: DataFrame, slot: list[str], bonus: float = UNANIMOUS) -> DataFrame:
    """``scored`` with ``gated``: the score and a bonus where a slot has one candidate, and without candidates of fewer families than the slot's most."""
    rows = scored.withColumns({"__n": F.count(F.lit(1)).over(Window.partitionBy(*slot)), "__most": F.max("families").over(Window.partitionBy(*slot))})
    rows = rows.filter(F.col("families") == F.col("__most")).withColumn("gated", F.col("score") + F.when(F.col("__n") == 1, bonus).otherwise(0.0))
    return rows.drop("__n", "__most")


def corpus_bonus(unigram: Column, bigram: Column, trigram: Column) -> Column:
    """The bonus that corpus counts give a token: none without a bigram or trigram, and never over its cap."""
    parts = [w * F.least(F.log1p(n.cast("double")), F.lit(cap)) for w, n, cap in zip(CORPUS_WEIGHTS, (unigram, bigram, trigram), CORPUS_CAPS, strict=True)]
    return F.when((bigram > 0) | (trigram > 0), F.least(F.lit(CORPUS_MOST), parts[0] + parts[1] + parts[2])).otherwise(F.lit(0.0))


def capped(rows: DataFrame, keys: list[str], order: list[Column], each: int, overall: int) -> DataFrame:
    """The first ``overall`` rows in the order given of those that are among the first ``each`` of their keys (a report)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("place", place).filter(F.col("place") <= each).orderBy(*order).limit(overall)
