"""Names heard differently: fuzzy votes, two-key matches, frames, weighted choices, phrase windows and best aliases.

Similarities are functions of two columns, so that any measure may be used. Every join is an equality: one side is listed under each
length that the other may have, and under a block where the caller gives one; distinct texts are compared once, whoever says them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Similarity = Callable[[Column, Column], Column]

# Similarity that a strict and any other term asks for, families that decide; similarity of a supported phrase window;
# share of a length that an alias may have, similarity that lists it, and similarity and lead that accept it; reach of a cue.
STRICT, TERM, FAMILIES = 0.95, 0.88, 2
SUPPORTED = 0.72
SHORTEST, LONGEST, LISTED, ACCEPTED, LEAD = 0.55, 1.65, 0.50, 0.74, 0.055
CUE_REACH = 9


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the Levenshtein distance over the longer length; 1 for two empty strings."""
    return F.when(F.greatest(F.char_length(a), F.char_length(b)) > 0, 1 - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b))).otherwise(F.lit(1.0))


def pairs_of_lengths(left: DataFrame, right: DataFrame, low: Column, high: Column, keys: list[str]) -> DataFrame:
    """Distinct (keys, a) of ``left`` with distinct (keys, b, ...) of ``right`` whose length is between ``low`` and ``high``, which are columns of ``length`` of a."""
    a = left.select(*keys, "a").distinct().withColumn("length", F.char_length("a"))
    a = a.withColumn("__length", F.explode(F.sequence(F.greatest(F.lit(0), low.cast("int")), high.cast("int")))).drop("length")
    return a.join(right.withColumn("__length", F.char_length("b")), [*keys, "__length"]).drop("__length")


def matched_terms(tokens: DataFrame, terms: DataFrame, similarity: Similarity, block: Callable[[Column], Column], strict: float = STRICT, least: float = TERM) -> DataFrame:
    """(token, identity, similarity): the best alias of each identity that a token is similar enough to.

    ``terms`` are (term, identity, is_strict). Lengths differ by one at most for tokens of up to four characters, else by two.
    """
    radius = F.when(F.col("length") <= 4, 1).otherwise(2)
    left = tokens.select(F.col("token").alias("a")).distinct().withColumn("block", block(F.col("a")))
    right = terms.select(F.col("term").alias("b"), "identity", "is_strict", block(F.col("term")).alias("block")).distinct()
    pairs = pairs_of_lengths(left, right, F.col("length") - radius, F.col("length") + radius, ["block"]).withColumn("similarity", similarity(F.col("a"), F.col("b")))
    found = pairs.filter(F.col("similarity") >= F.when(F.col("is_strict"), strict).otherwise(least))
    return found.groupBy(F.col("a").alias("token"), "identity").agg(F.max("similarity").alias("similarity"))


def fuzzy_vote(observed: DataFrame, terms: DataFrame, similarity: Similarity, block: Callable[[Column], Column], slot: list[str], strict: float = STRICT, least: float = TERM, families: int = FAMILIES) -> DataFrame:
    """(slot, identity, families, similarity): per slot of (slot, family, token) the identity that most families say, two at least.

    A family says each identity as similarly as its best token does; ties go by the mean of that, then by identity.
    """
    known = matched_terms(observed, terms, similarity, block, strict, least)
    said = observed.select(*slot, "family", "token").distinct().join(known, "token").groupBy(*slot, "family", "identity").agg(F.max("similarity").alias("best"))
    voted = said.groupBy(*slot, "identity").agg(F.count(F.lit(1)).alias("families"), F.round(F.avg("best"), 6).alias("similarity")).filter(F.col("families") >= families)
    order = Window.partitionBy(*slot).orderBy(F.desc("families"), F.desc("similarity"), "identity")
    return voted.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def two_key_matches(left: DataFrame, right: DataFrame, key: Callable[[Column], Column], similarity: Similarity, keys: list[str], radius: int = 3, spelling: float = 0.76, sound: float = 0.78) -> DataFrame:
    """(keys, term, match, similarity): similar by spelling, or by ``key`` of both, with the greater of the two similarities."""
    found = None
    for by, least in ((lambda c: c, spelling), (key, sound)):
        a = left.select(*keys, "term", by(F.col("term")).alias("a"))
        b = right.select(*keys, F.col("term").alias("match"), by(F.col("term")).alias("b")).distinct()
        pairs = pairs_of_lengths(a, b.select(*keys, "b").distinct(), F.col("length") - radius, F.col("length") + radius, keys)
        pairs = pairs.withColumn("similarity", similarity(F.col("a"), F.col("b"))).filter(F.col("similarity") >= least)
        pairs = a.distinct().join(pairs, [*keys, "a"]).join(b, [*keys, "b"]).filter("term <> match").select(*keys, "term", "match", "similarity")
        found = pairs if found is None else found.unionByName(pairs)
    return found.groupBy(*keys, "term", "match").agg(F.max("similarity").alias("similarity"))


def frames(tokens: DataFrame, keys: list[str], sets: list[list[str]], reaches: list[int]) -> DataFrame:
    """(keys, at_0, at_1, ...): each token (keys, pos, tok) of the first set, with the next one of each further set at most so many places behind.

    Read with one window for each set: the nearest place of a set at or behind a row, then looked up step by step.
    """
    ahead = Window.partitionBy(*keys).orderBy("pos")
    rows = tokens.select(*keys, "pos", "tok")
    rows = rows.withColumns({f"is_{k}": F.col("tok").isin(s) for k, s in enumerate(sets)})
    for k in range(len(sets) - 1, 0, -1):
        # Of a row of set k that itself has the rest of the frame, its chain of places.
        own = F.when(F.col(f"is_{k}"), F.array(F.col("pos")) if k == len(sets) - 1 else F.when(F.col(f"chain_{k + 1}").isNotNull(), F.concat(F.array("pos"), F.col(f"chain_{k + 1}"))))
        rows = rows.withColumn(f"own_{k}", own).withColumn(f"chain_{k}", F.first(f"own_{k}", ignorenulls=True).over(ahead.rowsBetween(1, reaches[k - 1])))
    found = rows.filter(F.col("is_0") & F.col("chain_1").isNotNull())
    return found.select(*keys, F.col("pos").alias("at_0"), *(F.get("chain_1", F.lit(k)).alias(f"at_{k + 1}") for k in range(len(sets) - 1)))


def weighted(parts: Mapping[str, float]) -> Column:
    """The sum of columns times their weights; a null counts as 0."""
    out = F.lit(0.0)
    for name, weight in parts.items():
        out = out + F.lit(float(weight)) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return out


def weighted_choice(candidates: DataFrame, keys: list[str], candidate: str, parts: Mapping[str, float], least: float, margin: float) -> DataFrame:
    """The best candidate of each key by its weighted parts, the lead over the next, and ``accepted`` where score and lead suffice.

    Scores are rounded to 6 places before they are compared; ties go by candidate, and a tie leads by nothing.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), candidate)
    rows = candidates.withColumn("score", F.round(weighted(parts), 6)).withColumns({"__rank": F.row_number().over(order), "__next": F.lead("score").over(order)})
    lead = F.round(F.col("score") - F.coalesce("__next", F.lit(0.0)), 6)
    out = rows.filter("__rank = 1").withColumn("lead", lead).withColumn("accepted", (F.col("score") >= least) & (F.col("lead") >= margin))
    return out.drop("__rank", "__next")


def windows_of(toks: Column, low: Column, high: Column) -> Column:
    """All runs of ``low`` to ``high`` neighbouring tokens, joined by spaces, as one array."""
    def of(n: Column) -> Column:
        last = F.size(toks) - n + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda i: F.array_join(F.slice(toks, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.sequence(F.greatest(F.lit(1), low), high), of))


def phrase_support(phrases: DataFrame, texts: DataFrame, keys: list[str], similarity: Similarity, least: float = SUPPORTED, families: int = FAMILIES, widest: int = 7) -> DataFrame:
    """(keys, phrase, families, similarity, supported) of the distinct (phrase) against (keys, family, toks).

    Windows have one word less to two more than the phrase, ``widest`` at most. A family supports a phrase with its closest window, if that
    is similar by ``least``; only phrases that some family supports appear. Lengths that rule the similarity out never meet.
    """
    known = phrases.select("phrase").distinct().withColumn("n", F.size(F.split("phrase", " ")))
    widths = known.select("n").distinct()
    each = texts.select(*keys, "family", "toks").join(widths)  # a row for each length that phrases have: few
    said = each.select(*keys, "family", "n", F.explode(F.array_distinct(windows_of(F.col("toks"), F.col("n") - 1, F.least(F.lit(widest), F.col("n") + 2)))).alias("window")).distinct()
    different = said.select("n", F.col("window").alias("b")).distinct()
    length = F.col("length")
    pairs = pairs_of_lengths(known.select("n", F.col("phrase").alias("a")), different, F.ceil(length * least), F.floor(length / least), ["n"])
    pairs = pairs.withColumn("similarity", similarity(F.col("a"), F.col("b"))).filter(F.col("similarity") >= least).withColumnsRenamed({"a": "phrase", "b": "window"})
    best = said.join(pairs, ["n", "window"]).groupBy(*keys, "phrase", "family").agg(F.max("similarity").alias("best"))
    out = best.groupBy(*keys, "phrase").agg(F.count(F.lit(1)).alias("families"), F.max("best").alias("similarity"))
    return out.withColumn("supported", F.col("families") >= families)


def best_aliases(heard: DataFrame, lexicon: DataFrame, similarity: Similarity, keep: int = 4) -> DataFrame:
    """(heard, identity, alias, similarity, rank, accepted): of each (heard) the best alias of each identity of (alias, identity), the best ``keep`` of those.

    An alias is listed with a length of 0.55 to 1.65 of what was heard and a similarity of 0.50. The first is accepted if it is equal, or
    similar by 0.74 and 0.055 ahead of the next.
    """
    length = F.col("length")
    pairs = pairs_of_lengths(heard.select(F.col("heard").alias("a")), lexicon.select(F.col("alias").alias("b"), "identity").distinct(), F.ceil(length * SHORTEST), F.floor(length * LONGEST), [])
    pairs = pairs.withColumn("similarity", F.round(similarity(F.col("a"), F.col("b")), 6)).filter(F.col("similarity") >= LISTED)
    best = pairs.groupBy(F.col("a").alias("heard"), "identity").agg(F.min(F.struct((-F.col("similarity")).alias("s"), F.col("b").alias("alias"))).alias("x"))
    best = best.select("heard", "identity", "x.alias", (-F.col("x.s")).alias("similarity"))
    order = Window.partitionBy("heard").orderBy(F.desc("similarity"), "identity")
    ranked = best.withColumns({"rank": F.row_number().over(order), "__lead": F.col("similarity") - F.coalesce(F.lead("similarity").over(order), F.lit(0.0))}).filter(F.col("rank") <= keep)
    sure = (F.col("heard") == F.col("alias")) | (F.col("similarity") >= ACCEPTED) & (F.round("__lead", 6) >= LEAD)
    return ranked.withColumn("accepted", (F.col("rank") == 1) & sure).drop("__lead")


def unsupported_fuzzy(claims: DataFrame, evidence: DataFrame, keys: list[str], similarity: Similarity, least: float = SUPPORTED) -> DataFrame:
    """Distinct tokens of (keys, tok) to which no evidence token of the same keys is equal, or similar by ``least``."""
    rest = claims.select(*keys, "tok").distinct().join(evidence.select(*keys, "tok").distinct(), [*keys, "tok"], "left_anti")
    length = F.col("length")
    pairs = pairs_of_lengths(rest.select(*keys, F.col("tok").alias("a")), evidence.select(*keys, F.col("tok").alias("b")).distinct(), F.ceil(length * least), F.floor(length / least), keys)
    near = pairs.filter(similarity(F.col("a"), F.col("b")) >= least).select(*keys, F.col("a").alias("tok")).distinct()
    return rest.join(near, [*keys, "tok"], "left_anti")


def near_cues(tokens: DataFrame, keys: list[str], cue: Column, reach: int = CUE_REACH) -> DataFrame:
    """(keys, pos, tok, ...) with ``cued``: whether a token at most ``reach`` places away is a cue."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(-reach, reach)
    return tokens.withColumn("cued", F.max(cue.cast("int")).over(w) == 1)


def without_suffix(token: Column, suffixes: list[str], stem: int = 4) -> Column:
    """The token without the first of ``suffixes`` that leaves a stem of so many characters, else as it is."""
    out = token
    for s in reversed(suffixes):
        out = F.when(token.endswith(s) & (F.char_length(token) >= len(s) + stem), F.substring(token, F.lit(1), F.char_length(token) - len(s))).otherwise(out)
    return out
