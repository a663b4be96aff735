"""Where models of others come in: functions of the caller's behind fixed checks, with deterministic ones that need nothing.

A chooser picks one of given options for each task, a writer makes a text of a source, an encoder makes vectors of texts. Each runs in
Arrow batches; whatever it gives that is not allowed, or raises, is replaced by the fallback and said so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Chooser = Callable[[list[dict]], dict[str, str]]
Writer = Callable[[str], str]
Encoder = Callable[[list[str]], np.ndarray]


def best_option(tasks: list[dict]) -> dict[str, str]:
    """The option of the highest score, ties by option: the chooser that needs no model."""
    return {t["id"]: max(zip(t["scores"], t["options"], strict=True), key=lambda x: (x[0], x[1]))[1] for t in tasks if len(t["options"])}


def chosen(tasks: DataFrame, chooser: Chooser = best_option, batch: int = 18) -> DataFrame:
    """(id, choice, source) of (id string, options array, scores array, fallback string), ``batch`` tasks at a time.

    An answer must name every task of its batch and no other, each with one of its options. Where the chooser raises, or names other
    tasks, the whole batch falls back; where a choice is no option, that task does.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for at in range(0, len(pdf), batch):
                own = [{"id": r.id, "options": list(r.options), "scores": list(r.scores), "fallback": r.fallback} for r in pdf.iloc[at : at + batch].itertuples()]
                try:
                    answer = chooser([{k: t[k] for k in ("id", "options", "scores")} for t in own])
                    whole = isinstance(answer, dict) and set(answer) == {t["id"] for t in own}
                except Exception:  # noqa: BLE001 - a model may fail in any way; none of it may stop the job
                    answer, whole = {}, False
                for t in own:
                    good = whole and answer[t["id"]] in t["options"]
                    rows.append((t["id"], answer[t["id"]] if good else t["fallback"], "chooser" if good else "fallback"))
            yield pd.DataFrame(rows, columns=["id", "choice", "source"])

    return tasks.select("id", "options", "scores", "fallback").mapInPandas(run, "id string, choice string, source string")


def first_sentences(text: str, most: int = 3) -> str:
    """The first sentences of a text: the writer that needs no model."""
    from lattica.operators.grounding import _SENTENCE

    return "".join(_SENTENCE.findall(text)[:most]).strip()


def written(sources: DataFrame, key: str, writer: Writer = first_sentences, longest: int = 4000) -> DataFrame:
    """(key, summary, source) of (key, text): what the writer makes, or the first sentences where it raises or gives nothing, too much, or no text."""
    kind = sources.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for k, text in zip(pdf[key], pdf["text"], strict=True):
                try:
                    made = writer(text or "")
                except Exception:  # noqa: BLE001 - see above
                    made = None
                good = isinstance(made, str) and 0 < len(made.strip()) <= longest
                rows.append((k, made.strip() if good else first_sentences(text or ""), "writer" if good else "fallback"))
            yield pd.DataFrame(rows, columns=[key, "summary", "source"])

    return sources.select(key, "text").mapInPandas(run, f"{key} {kind}, summary string, source string")


def hashed_words(texts: list[str], size: int = 64) -> np.ndarray:
    """Signed counts of hashed words: the encoder that needs no model."""
    out = np.zeros((len(texts), size))
    for row, text in zip(out, texts, strict=True):
        for word in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            row[h % size] += 1 if h >> 63 else -1
    return out


def encoded(texts: DataFrame, key: str, encoder: Encoder = hashed_words, batch: int = 64) -> DataFrame:
    """(key, embedding) of (key, text): vectors of length 1 of what the encoder gives for ``batch`` texts at a time; a zero vector stays zero."""
    kind = texts.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            vectors = [encoder([t or "" for t in pdf["text"].iloc[at : at + batch]]) for at in range(0, len(pdf), batch)]
            all_of = np.concatenate(vectors) if vectors else np.zeros((0, 0))
            lengths = np.linalg.norm(all_of, axis=1, keepdims=True) if len(all_of) else all_of
            yield pd.DataFrame({key: pdf[key], "embedding": list(np.divide(all_of, lengths, out=np.zeros_like(all_of), where=lengths > 0).astype(np.float32))})

    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, embedding array<float>")
