"""Claims against evidence: unsupported parts, gates, invariants and bounded repair."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rounds of the repair loop, similarity that supports a token, length ratio of an acceptable change.
ROUNDS, SUPPORTED, SHORTEST, LONGEST = 24, 0.72, 0.55, 1.80


def unsupported(claims: DataFrame, evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct tokens of (keys, tok) that no evidence row of the same keys has."""
    return claims.select(*keys, "tok").distinct().join(evidence.select(*keys, "tok").distinct(), [*keys, "tok"], "left_anti")


def first_reason(checks: dict[str, Column]) -> Column:
    """The first named check that holds, in order; null if none does."""
    out = None
    for name, check in checks.items():
        out = F.when(check, name) if out is None else out.when(check, name)
    return out


def all_reasons(checks: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(check, F.lit(name)) for name, check in checks.items())))


def confidence_cap(placeholders: Column, foreign_ratio: Column, agreement: Column, uncertain: Column, families: Column, stated: Column) -> Column:
    """The highest confidence that a claim may state."""
    low = (placeholders >= 2) | (foreign_ratio >= 0.08) | (agreement < 0.20) | (uncertain >= 3)
    medium = (placeholders == 1) | (foreign_ratio >= 0.02) | (agreement < 0.45) | (uncertain >= 1) | (families < 2)
    return F.when(low, "low").when(medium & (stated == "high"), "medium").otherwise(stated)


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many rows each side has too many; both 0 when they hold the same multiset."""
    extra, missing = (x.exceptAll(y).agg(F.count(F.lit(1)).alias(name)) for x, y, name in ((a, b, "n_extra"), (b, a, "n_missing")))
    return extra.join(missing)  # one row each


_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*\s*")
_WORD = re.compile(r"[^\W\d_]+|\d+")


def repaired(claim: str, evidence: str, rounds: int = ROUNDS) -> tuple[str, int, list[str]]:
    """Removes one thing at a time that the evidence does not hold: first a number, then the sentence with most unknown words, until all is supported or nothing changes.

    Returns what is left, the rounds taken and what each did.
    """
    known, done = set(_WORD.findall(evidence.lower())), []
    for _ in range(rounds):
        numbers = [n for n in re.findall(r"\d+", claim) if n not in known]
        sentences = _SENTENCE.findall(claim)
        unknown = [sum(w not in known for w in _WORD.findall(s.lower())) for s in sentences]
        if numbers:
            claim = re.sub(rf"\b{numbers[0]}\b ?", "", claim)
            done.append(f"number {numbers[0]}")
        elif sentences and max(unknown) > 0:
            worst = unknown.index(max(unknown))
            claim = "".join(s for k, s in enumerate(sentences) if k != worst)
            done.append("sentence")
        else:
            break
    return claim.strip(), len(done), done


def repair(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, kept_text, rounds, supported, confidence) of (key, claim, evidence)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            rows = []
            for k, claim, evidence in zip(pdf[key], pdf["claim"], pdf["evidence"], strict=True):
                text, n, _ = repaired(claim or "", evidence or "")
                known = set(_WORD.findall((evidence or "").lower()))
                ok = all(w in known for w in _WORD.findall(text.lower()))
                rows.append((k, text, n, ok, "high" if n == 0 else "medium" if n == 1 else "low"))
            yield pd.DataFrame(rows, columns=[key, "kept_text", "rounds", "supported", "confidence"])

    return df.select(key, "claim", "evidence").mapInPandas(run, f"{key} {kind}, kept_text string, rounds int, supported boolean, confidence string")


def without_adjacent(toks: Column) -> Column:
    """The words of an array without those that are the same as the one before."""
    at = F.sequence(F.lit(1), F.size(toks))
    kept = F.filter(at, lambda i: (i == 1) | (F.element_at(toks, F.greatest(F.lit(1), i - 1)) != F.element_at(toks, i)))
    return F.when(F.size(toks) > 0, F.transform(kept, lambda i: F.element_at(toks, i))).otherwise(toks)


def collapse_repeats(words: list[str], widest: int = 6) -> list[str]:
    """One of words that stand twice or more in a row, and one of phrases of up to ``widest`` words that stand three times or more; longest first."""
    out = list(words)
    for width in range(widest, 0, -1):
        i, least = 0, 2 if width == 1 else 3
        while i + width <= len(out):
            n = 1
            while out[i + n * width : i + (n + 1) * width] == out[i : i + width]:
                n += 1
            if n >= least:
                del out[i + width : i + n * width]
            i += 1
    return out


def collapsed(rows: DataFrame, keys: list[str], widest: int = 6) -> DataFrame:
    """(keys, kept, removed) of (keys, toks): what ``collapse_repeats`` leaves, as text, and how many words it takes out."""
    from pyspark.sql.types import StringType

    @F.pandas_udf(StringType())
    def kept(toks: pd.Series) -> pd.Series:
        return toks.map(lambda t: " ".join(collapse_repeats(list(t), widest)))

    out = rows.select(*keys, F.size("toks").alias("n"), kept("toks").alias("kept"))
    left = F.when(F.col("kept") == "", 0).otherwise(F.size(F.split("kept", " ")))
    return out.select(*keys, "kept", (F.col("n") - left).alias("removed"))
