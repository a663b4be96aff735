"""Slots of a decoded sequence: uncertainty, sensitivity, quality, gates, priors, locks, regions and rule scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators import intervals
from lattica.operators.grounding import all_reasons, first_reason
from lattica.operators.names import weighted

# Limits of the first and the second stage of doubt, and the similarity of times below which a counterpart is missing.
DOUBT = ({"avg_logprob": -0.72, "compression_ratio": 2.15, "no_speech_prob": 0.38, "mean_probability": 0.63, "similarity": 0.62, "word_probability": 0.43, "word_similarity": 0.72}, {"avg_logprob": -0.78, "compression_ratio": 2.20, "no_speech_prob": 0.45, "mean_probability": 0.58, "similarity": 0.70, "word_probability": 0.38, "word_similarity": 0.68})
ABSENT = 0.45
# Parts of the quality of an observation.
SPREAD, ENHANCED = 0.18, 0.025
# Parts of a local score; lead from which it is a prior, its base, slope and most.
LOCAL = {"emission": 0.18, "local": 0.28, "global": 0.08, "context": 0.34, "common": 0.12}
PRIOR_LEAD, PRIOR_BASE, PRIOR_SLOPE, PRIOR_MOST = 0.035, 3.5, 10.0, 6.0
# Places and seconds between uncertain slots of one region, and its padding in places.
PLACES, SECONDS, PADDED = 3, 1.4, 2


def doubts(stage: int) -> Column:
    """Why a segment is doubtful at stage 0 or 1, from its columns avg_logprob, compression_ratio, no_speech_prob, mean_probability, similarity, word_probability, word_similarity, critical, foreign and counterpart.

    At stage 1 text in a foreign script, or without a counterpart, is that and nothing else.
    """
    limit = DOUBT[stage]
    over = ("compression_ratio", "no_speech_prob")
    checks = {name: (F.col(name) > value) if name in over else (F.col(name) < value) for name, value in limit.items()}
    checks["critical"] = F.col("critical")
    alone = {"foreign": F.col("foreign"), "missing": F.coalesce(F.col("counterpart") < ABSENT, F.lit(True))}
    if stage == 0:
        return all_reasons({**checks, **alone})
    only = first_reason(alone)
    return F.when(only.isNotNull(), F.array(only)).otherwise(all_reasons(checks))


def sensitivity(tokens: DataFrame, keys: list[str], kinds: Mapping[str, Column], reach: int = 2) -> DataFrame:
    """``tokens`` (keys, pos, ...) with ``sensitive``: the kinds that hold of a token at most ``reach`` places away, in order."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-reach, reach)
    return tokens.withColumn("sensitive", F.array_compact(F.array(*(F.when(F.max(F.coalesce(c, F.lit(False))).over(w), F.lit(name)) for name, c in kinds.items()))))


def observation_quality(probability: Column, logprob: Column, enhanced: Column) -> Column:
    """Probability, a share of the log probability between -2 and 0, and a little for enhanced sources."""
    level = (F.greatest(F.lit(-2.0), F.least(F.lit(0.0), F.coalesce(logprob, F.lit(-2.0)))) + 2) / 2
    return F.coalesce(probability, F.lit(0.0)) + SPREAD * level + F.when(enhanced, ENHANCED).otherwise(0.0)


def effective_families(*lists: Column) -> Column:
    """The size of the largest of several lists of families."""
    sizes = [F.coalesce(F.size(x), F.lit(0)) for x in lists]
    return F.greatest(F.lit(0), *sizes)


def similar_neighbours(scored: DataFrame, keys: list[str], slot: str, similarity, strong: float, loose: float, overlap: float = 0.35) -> DataFrame:  # noqa: ANN001
    """``scored`` (keys, slot, candidate, start, end, score) with ``support``: 1.45 for each neighbouring slot with a candidate similar by ``strong``, 0.26 by ``loose``, whose time overlaps by so much of the shorter."""
    near = scored.select(*keys, F.explode(F.array(F.col(slot) - 1, F.col(slot) + 1)).alias(slot), F.col(slot).alias("__from"), F.col("candidate").alias("__other"), F.col("start").alias("__start"), F.col("end").alias("__end"))
    shared = F.least("end", "__end") - F.greatest("start", "__start")
    shorter = F.greatest(F.lit(0.001), F.least(F.col("end") - F.col("start"), F.col("__end") - F.col("__start")))
    pairs = scored.join(near, [*keys, slot]).filter(shared / shorter >= overlap)
    best = pairs.groupBy(*keys, slot, "candidate", "__from").agg(F.max(similarity(F.col("candidate"), F.col("__other"))).alias("s"))
    worth = F.when(F.col("s") >= strong, 1.45).when(F.col("s") >= loose, 0.26).otherwise(0.0)
    found = best.groupBy(*keys, slot, "candidate").agg(F.round(F.sum(worth), 6).alias("support"))
    return scored.join(found, [*keys, slot, "candidate"], "left").withColumn("support", F.coalesce("support", F.lit(0.0)))


def gated(candidates: DataFrame, locked: Column, base: Column, checks: Mapping[str, Column]) -> DataFrame:
    """``candidates`` with ``gate``: null for those allowed; in a locked slot only the base is, elsewhere what no check refuses, and the base always."""
    return candidates.withColumn("gate", F.when(~base, F.when(locked, "locked").otherwise(first_reason(dict(checks)))))


def local_priors(candidates: DataFrame, slot: list[str], parts: Mapping[str, float] = LOCAL) -> DataFrame:
    """The best candidate of each slot by its parts, each scaled to 0 to 1 within the slot, its lead, and the prior that a lead of 0.035 or more gives it."""
    w = Window.partitionBy(*slot)
    scaled = candidates
    for name in parts:
        low, high = F.min(name).over(w), F.max(name).over(w)
        scaled = scaled.withColumn(name, F.when(high > low, (F.col(name) - low) / (high - low)).otherwise(F.lit(0.5)))
    order = w.orderBy(F.desc("score"), "candidate")
    rows = scaled.withColumn("score", F.round(weighted(parts), 6)).withColumns({"__rank": F.row_number().over(order), "__next": F.lead("score").over(order)}).filter("__rank = 1")
    lead = F.round(F.col("score") - F.coalesce("__next", F.lit(0.0)), 6)
    prior = F.when(lead >= PRIOR_LEAD, F.round(F.least(F.lit(PRIOR_MOST), PRIOR_BASE + PRIOR_SLOPE * lead), 6)).otherwise(0.0)
    return rows.select(*slot, "candidate", "score", lead.alias("lead"), prior.alias("prior"))


def critical_prior(critical: Column, families: Column, in_frame: Column, score: Column, prior: float = 5.0, most: float = 7.0) -> Column:
    """What two families other than the base give a critical value inside a frame; elsewhere ten times what a repair's score has over 0.5, ``most`` at most."""
    repair = F.greatest(F.lit(0.0), F.least(F.lit(most), 10 * (score - 0.5)))
    return F.when(critical & in_frame & (families >= 2), F.lit(prior)).otherwise(repair)


def first_usable(parts: list[tuple[str, Column, Column]]) -> Column:
    """A struct of ``source`` and ``text``: the first of (name, text, usable) that is usable; nulls if none is."""
    name, text = F.lit(None).cast("string"), F.lit(None).cast("string")
    for n, t, usable in reversed(parts):
        good = F.coalesce(usable, F.lit(False))
        name, text = F.when(good, F.lit(n)).otherwise(name), F.when(good, t).otherwise(text)
    return F.struct(name.alias("source"), text.alias("text"))


def locked_slots(slots: DataFrame, locks: DataFrame, keys: list[str], width: float) -> DataFrame:
    """``slots`` (keys, slot, start, end, word) with ``word`` as the locks (keys, lock, start, end, value) will have it, and ``lock``.

    The first slot that a lock overlaps says its value, its other ones nothing. A slot under several locks goes by the first of them.
    """
    pairs = intervals.overlaps(slots.select(*keys, "slot", "start", "end"), locks.select(*keys, "lock", "value", "start", "end"), keys, width)
    own = pairs.groupBy(*keys, F.col("l_slot").alias("slot")).agg(F.min(F.struct(F.col("r_start").alias("s"), F.col("r_lock").alias("lock"), F.col("r_value").alias("value"), F.col("l_start").alias("at"))).alias("x"))
    own = own.select(*keys, "slot", "x.lock", "x.value", "x.at")
    first = own.groupBy(*keys, "lock").agg(F.min(F.struct("at", "slot")).alias("first")).select(*keys, "lock", F.col("first.slot").alias("__first"))
    said = own.join(first, [*keys, "lock"]).select(*keys, "slot", "lock", F.when(F.col("slot") == F.col("__first"), F.col("value")).otherwise("").alias("__word"))
    return slots.join(said, [*keys, "slot"], "left").withColumn("word", F.coalesce("__word", "word")).drop("__word")


def regions(slots: DataFrame, keys: list[str], uncertain: Column, severity: Column, most: int, places: int = PLACES, seconds: float = SECONDS, padded: int = PADDED) -> DataFrame:
    """(keys, first, last, members, density): stretches of uncertain slots of (keys, pos, at), padded, merged where they touch, the ``most`` densest of all (a report)."""
    own = slots.select(*keys, "pos", "at", severity.alias("__severity"), uncertain.alias("__uncertain"))
    bad = own.filter("__uncertain")
    w = Window.partitionBy(*keys).orderBy("pos")
    new = F.lag("pos").over(w).isNull() | (F.col("pos") - F.lag("pos").over(w) > places) | (F.col("at") - F.lag("at").over(w) > seconds)
    runs = bad.withColumn("__new", new.cast("int")).withColumn("__run", F.sum("__new").over(w))
    stretches = runs.groupBy(*keys, "__run").agg((F.min("pos") - padded).alias("start"), (F.max("pos") + padded).alias("end"), F.sum("__severity").alias("severity"), F.count(F.lit(1)).alias("n"))
    reach = F.max("end").over(Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1))
    parts = stretches.withColumn("__new", (reach.isNull() | (F.col("start") > reach + 1)).cast("int")).withColumn("__region", F.sum("__new").over(Window.partitionBy(*keys).orderBy("start", "end")))
    found = parts.groupBy(*keys, "__region").agg(F.greatest(F.lit(0), F.min("start")).alias("first"), F.max("end").alias("last"), F.sum("n").alias("members"), F.sum("severity").alias("severity"))
    found = found.withColumn("density", F.round(F.col("severity") / (F.col("last") - F.col("first") + 1), 6))
    return found.orderBy(F.desc("density"), *keys, "first").limit(most).select(*keys, "first", "last", "members", "density")


def rule_score(rules: list[tuple[str, Column, float]], scale: float = 4.0) -> tuple[Column, Column]:
    """tanh of the sum of the weights of the rules that hold over ``scale``, and their names in order."""
    total = F.lit(0.0)
    for _, rule, weight in rules:
        total = total + F.when(rule, F.lit(float(weight))).otherwise(0.0)
    return F.tanh(total / scale), all_reasons({name: rule for name, rule, _ in rules})


def verb_like(toks: DataFrame, stems: DataFrame, prefixes: list[str], suffixes: list[str], least: int = 3) -> DataFrame:
    """(tok, stem): tokens of (tok) that are a prefix, a stem of (stem) of so many characters and a suffix; one of them may be empty, not both."""
    own = toks.select("tok").distinct()
    parts = [(p, s) for p in ["", *prefixes] for s in ["", *suffixes] if p or s]
    cut = [F.when(F.col("tok").startswith(p) & F.col("tok").endswith(s) & (F.char_length("tok") >= len(p) + len(s) + least), F.substring("tok", F.lit(len(p) + 1), F.char_length("tok") - len(p) - len(s))) for p, s in parts]
    each = own.select("tok", F.explode(F.array_distinct(F.array_compact(F.array(*cut)))).alias("stem"))
    return each.join(stems.select("stem").distinct(), "stem", "left_semi").select("tok", "stem")
