"""Votes of candidates by independent families: scores, margins, neighbours, agreement and multisets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the vote score and of the emission score.
VOTE, FAMILY, CONFIDENCE = 1.0, 0.35, 0.5
EXACT, STRONG, LOOSE, SOURCE, PROBABILITY, REPEAT_FAMILY, REPEAT_COUNT, UNOBSERVED = 2.20, 1.45, 0.26, 0.16, 0.42, 0.32, 0.11, 0.64


def votes(df: DataFrame, slot: list[str]) -> DataFrame:
    """Per slot and candidate of (slot, candidate, family, confidence): votes, distinct families, mean of each family's best confidence, score."""
    best = df.groupBy(*slot, "candidate", "family").agg(F.max("confidence").alias("best"), F.count(F.lit(1)).alias("n"))
    out = best.groupBy(*slot, "candidate").agg(F.sum("n").alias("votes"), F.count(F.lit(1)).alias("families"), F.avg("best").alias("confidence"))
    return out.withColumn("score", VOTE * F.col("votes") + FAMILY * F.col("families") + CONFIDENCE * F.col("confidence"))


def margins(scored: DataFrame, slot: list[str]) -> DataFrame:
    """The winner of each slot, its margin over the runner-up, and a verdict; ties by candidate."""
    w = Window.partitionBy(*slot).orderBy(F.desc("score"), "candidate")
    rows = scored.withColumns({"rank": F.row_number().over(w), "runner_up": F.lead("score").over(w)}).filter("rank = 1").drop("rank")
    margin = F.col("score") - F.coalesce("runner_up", F.lit(0.0))
    verdict = F.when((F.col("families") >= 3) & (margin >= -0.25), "ACCEPT").when(F.col("families") >= 2, "REVIEW").otherwise("KEEP_SOURCE")
    return rows.withColumns({"margin": margin, "verdict": verdict}).drop("runner_up")


def neighbour_support(scored: DataFrame, keys: list[str], slot: str, bonus: float = STRONG) -> DataFrame:
    """Score plus ``bonus`` for each of the slots before and after that has the same candidate."""
    near = scored.select(*keys, F.explode(F.array(F.col(slot) - 1, F.col(slot) + 1)).alias(slot), "candidate").withColumn("__one", F.lit(1))
    near = near.groupBy(*keys, slot, "candidate").agg(F.sum("__one").alias("neighbours"))
    rows = scored.join(near, [*keys, slot, "candidate"], "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)).cast("long"))
    return rows.withColumn("supported", F.col("score") + bonus * F.col("neighbours"))


def emission(exact: Column, strong: Column, loose: Column, sources: Column, probability: Column, repeat_families: Column, repeats: Column, observed: Column) -> Column:
    """The emission score of a candidate from its support."""
    zero = F.lit(0)
    return (
        EXACT * exact + STRONG * F.greatest(zero, strong - exact) + LOOSE * F.greatest(zero, loose - strong) + SOURCE * sources + PROBABILITY * probability
        + REPEAT_FAMILY * repeat_families + REPEAT_COUNT * F.log1p(repeats) - F.when(observed, 0.0).otherwise(UNOBSERVED)
    )


def family_jaccard(df: DataFrame) -> DataFrame:
    """|A and B| / |A or B| of the distinct tokens of each pair of families in (grp, family, tok), from counts alone: no family's tokens are gathered.

    Tokens of the same families count together, so pairs are formed once for each set of families that occurs.
    """
    each = df.select("grp", "family", "tok").distinct()
    sizes = each.groupBy("grp", "family").agg(F.count(F.lit(1)).alias("n"))
    of = each.groupBy("grp", "tok").agg(F.array_sort(F.collect_set("family")).alias("families")).filter(F.size("families") > 1)
    sets = of.groupBy("grp", "families").agg(F.count(F.lit(1)).alias("n"))
    first = sets.select("grp", "families", "n", F.posexplode("families").alias("at", "family_a"))
    pairs = first.select("grp", "n", "family_a", F.explode(F.slice("families", F.col("at") + 2, F.size("families"))).alias("family_b"))
    both = pairs.groupBy("grp", "family_a", "family_b").agg(F.sum("n").alias("common"))
    a, b = (sizes.select("grp", F.col("family").alias(f"family_{x}"), F.col("n").alias(f"n_{x}")) for x in "ab")
    out = both.join(a, ["grp", "family_a"]).join(b, ["grp", "family_b"])
    return out.select("grp", "family_a", "family_b", "common", F.round(F.col("common") / (F.col("n_a") + F.col("n_b") - F.col("common")), 6).alias("jaccard"))


def multiset_excess(claim: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens of which a claim has more than its evidence, and by how many."""
    a = claim.groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("n_claim"))
    b = evidence.groupBy(*keys, "tok").agg(F.count(F.lit(1)).alias("n_evidence"))
    return a.join(b, [*keys, "tok"], "left").select(*keys, "tok", (F.col("n_claim") - F.coalesce("n_evidence", F.lit(0))).alias("excess")).filter("excess > 0")


def pruned(scored: DataFrame, slot: list[str], keep: int = 8) -> DataFrame:
    """The empty candidate of a slot and its ``keep`` best others, those observed or with two strong families."""
    worth = scored.filter(F.col("candidate") != "").filter("observed OR families >= 2")
    w = Window.partitionBy(*slot).orderBy(F.desc("families"), F.desc("score"), "candidate")
    best = worth.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= keep).drop("__rank")
    return best.unionByName(scored.filter(F.col("candidate") == ""))
