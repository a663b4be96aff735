"""String and vector similarities. Three different string measures are kept apart: Indel, partial Indel and Ratcliff-Obershelp."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, by a fold over the characters of ``a`` that keeps one row of the table."""
    right = F.split(b, "")
    zero = F.transform(F.sequence(F.lit(0), F.size(right)), lambda _: F.lit(0))

    def row(above: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            same = F.element_at(right, j) == x
            best = F.when(same, F.element_at(above, j) + 1).otherwise(F.greatest(F.element_at(above, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.size(right)), F.array(F.lit(0)), cell)

    length = F.aggregate(F.split(a, ""), zero, row, lambda acc: F.element_at(acc, -1))
    return F.when((F.char_length(a) > 0) & (F.char_length(b) > 0), length).otherwise(F.lit(0))


def indel_ratio(a: Column, b: Column) -> Column:
    """2 LCS / (len a + len b); 1 for two empty strings."""
    total = F.char_length(a) + F.char_length(b)
    return F.when(total > 0, 2.0 * lcs_length(a, b) / total).otherwise(F.lit(1.0))


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def indel(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Best Indel ratio of the shorter string with any window of its length in the longer."""

    def best(x: str, y: str) -> float:
        short, long = sorted((x or "", y or ""), key=len)
        return max(indel(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))

    return pd.Series([best(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(DoubleType())
def ratcliff_obershelp(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def composite(a: Column, b: Column, key: Callable[[Column], Column], shared_stem: Column | None = None, stem_worth: float = 0.84) -> Column:
    """1 for equal, 0 for an empty side, else the best of the Indel ratios of the words and of their keys, and ``stem_worth`` where they share a stem."""
    parts = [indel_ratio(a, b), indel_ratio(key(a), key(b))]
    if shared_stem is not None:
        parts.append(F.when(shared_stem, F.lit(stem_worth)).otherwise(F.lit(0.0)))
    empty = (F.char_length(a) == 0) | (F.char_length(b) == 0)
    return F.when(empty, F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(F.greatest(*parts))
