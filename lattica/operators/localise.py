"""Where a changed phrase stands in another version of a text, and replacing it there."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from lattica.functions.similarity import indel

# How many words a window may be shorter or longer; weights of the phrase and of the words on either side; score and lead that decide.
WIDER = 2
OWN, SIDE = 0.78, 0.11
ENOUGH, SURE, LEAD = 0.70, 0.72, 0.025


def _ends(words: Sequence[str], other: Sequence[str]) -> float:
    """How alike the words next to a window are to those wanted there; nothing wanted is no evidence either way."""
    return indel(" ".join(words), " ".join(other)) if other else 0.5


def windows(text: Sequence[str], phrase: Sequence[str], left: Sequence[str], right: Sequence[str]) -> list[tuple[float, int, int]]:
    """Score, first word and end of each window of ``text`` about as long as the phrase, best first, ties by place and then by width."""
    out, wanted = [], " ".join(phrase)
    for width in range(max(1, len(phrase) - WIDER), len(phrase) + WIDER + 1):
        for at in range(len(text) - width + 1):
            beside = SIDE * _ends(text[max(0, at - len(left)) : at], left) + SIDE * _ends(text[at + width : at + width + len(right)], right)
            out.append((round(OWN * indel(" ".join(text[at : at + width]), wanted) + beside, 9), at, at + width))
    return sorted(out, key=lambda x: (-x[0], x[1], x[2]))


def place_of(text: Sequence[str], phrase: Sequence[str], left: Sequence[str] = (), right: Sequence[str] = ()) -> tuple[int, int] | None:
    """The window that the phrase stands at, or None where no score is enough, or one that does not overlap the best is nearly as good."""
    found = windows(text, phrase, left, right)
    if not found or found[0][0] < (SURE if left or right else ENOUGH):
        return None
    score, first, end = found[0]
    rival = next((s for s, a, b in found[1:] if b <= first or a >= end), None)
    return None if rival is not None and score - rival < LEAD else (first, end)


def replaced(text: Sequence[str], changes: Sequence[tuple[Sequence[str], Sequence[str], Sequence[str], Sequence[str]]]) -> tuple[list[str], int]:
    """``text`` with each change (phrase, new words, words to the left, words to the right) that has a place, from right to left; and how many had.

    Places are found in the text as it was; of changes whose places overlap the one further right is made.
    """
    places = sorted(((p, new) for phrase, new, left, right in changes if (p := place_of(text, phrase, left, right))), key=lambda x: x[0], reverse=True)
    out, made, before = list(text), 0, len(text) + 1
    for (first, end), new in places:
        if end <= before:
            out[first:end] = new
            made, before = made + 1, first
    return out, made


def projected(rows: DataFrame, key: str) -> DataFrame:
    """(key, text, n_changes, n_made) of (key, text string, changes array<struct<phrase, new, left_context, right_context: string>>), words parted by spaces."""
    kind = rows.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for k, text, changes in zip(pdf[key], pdf["text"], pdf["changes"], strict=True):
                given = [] if changes is None else [tuple((c[f] or "").split() for f in ("phrase", "new", "left_context", "right_context")) for c in changes]
                words, made = replaced((text or "").split(), given)
                out.append((k, " ".join(words), len(given), made))
            yield pd.DataFrame(out, columns=[key, "text", "n_changes", "n_made"])

    return rows.select(key, "text", "changes").mapInPandas(run, f"{key} {kind}, text string, n_changes int, n_made int")
