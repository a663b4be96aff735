"""Benchmark decontamination by winnowing.

Of every document and item the minimum 5-gram hash of each 6 neighbouring 5-grams is kept as a fingerprint. Whatever two texts
share over 10 words or more holds one such window whole, so both keep the same fingerprint in it. Matching fingerprints are
extended to both sides word by word, and what is shared over 10 words or more is hit. Items under 10 words are one window: their
whole hash is looked up at every word and compared.

While the items are at most ``block_windows`` windows, their fingerprints are broadcast to the documents, which are never shuffled.
With more, fingerprints of documents and items are joined; only texts that have one in common are looked at further, in one pass for
each block of items, and what each row has been hit by so far goes along in the row through a written table.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import chunks, giving_back, materialize, table, text_key, utf8
from lattica.llm.words import gram_hashes, sliding_min, word_hashes, words_of

WINDOW = 10
GRAM = 5
#: About 100 MB of fingerprints and words; larger sets of items are taken in blocks.
BLOCK_WINDOWS = 500_000

_FOUND = "__spans binary, __items array<string>"


def _winnowed(grams: np.ndarray, first: np.ndarray, last: np.ndarray, window: int) -> np.ndarray:
    """Places of 5-grams that are the minimum of a window of ``window - GRAM + 1`` grams inside one document (words first..last)."""
    width = window - GRAM + 1
    lows = sliding_min(grams, width)
    if not len(lows):
        return np.zeros(0, np.int64)
    keep = np.zeros(len(grams), bool)
    whole = np.zeros(len(lows) + 1, np.int32)  # windows that do not leave their document
    has = last - first >= window
    np.add.at(whole, first[has], 1)
    np.add.at(whole, np.minimum(last[has] - window + 1, len(lows)), -1)
    whole = np.cumsum(whole[:-1]) > 0
    for j in range(width):
        keep[j : j + len(lows)] |= whole & (grams[j : j + len(lows)] == lows)
    return np.flatnonzero(keep)


class ItemIndex:
    """Fingerprints of a block of items: gram hash to places, words of the items, short items by length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window, self.ids, self.words = window, [], []
        self.short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            raw = text.encode()
            low, starts, ends, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            if not len(starts):
                continue
            hashes, whole, k = word_hashes(low, starts, ends), low.tobytes(), len(self.ids)
            self.ids.append(item_id)
            self.words.append([whole[a:b] for a, b in zip(starts, ends, strict=True)])
            if len(starts) < window:
                self.short[len(starts)][int(gram_hashes(hashes, len(starts))[0])].append(k)
                continue
            grams = gram_hashes(hashes, GRAM)
            for at in _winnowed(grams, np.array([0]), np.array([len(starts)]), window):
                places[int(grams[at])].append((k, int(at)))
        self.places = dict(places)
        self.short = {n: dict(x) for n, x in self.short.items()}
        self.sorted = np.sort(np.array(list(places), np.uint64))
        self.sorted_short = {n: np.sort(np.array(list(x), np.uint64)) for n, x in self.short.items()}

    def fingerprints(self) -> set[int]:
        return {*self.places, *(h for x in self.short.values() for h in x)}

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
        """Number of words of each document, and for those with hits a list of (first word, end, item)."""
        low, starts, ends, first = words_of(data, offsets)
        counts = np.diff(first)
        found: dict[int, set[tuple[int, int, int]]] = defaultdict(set)
        hashes, whole = word_hashes(low, starts, ends), low.tobytes()
        grams = gram_hashes(hashes, GRAM)
        at = _winnowed(grams, first[:-1], first[1:], self.window)
        at = at[_among(grams[at], self.sorted)]
        docs = np.searchsorted(first, at, "right") - 1
        for place, doc in zip(at.tolist(), docs.tolist(), strict=True):
            lo, hi = int(first[doc]), int(first[doc + 1])
            for item, where in self.places[int(grams[place])]:
                words, left, right = self.words[item], 0, 0
                while where - left >= 0 and place - left >= lo and whole[starts[place - left] : ends[place - left]] == words[where - left]:
                    left += 1
                while where + right < len(words) and place + right < hi and whole[starts[place + right] : ends[place + right]] == words[where + right]:
                    right += 1
                if left and left + right - 1 >= self.window:
                    found[doc].add((place - left + 1 - lo, place + right - lo, item))
        for n, known in self.short.items():
            grams = gram_hashes(hashes, n)
            at = np.flatnonzero(_among(grams, self.sorted_short[n]))
            docs = np.searchsorted(first, at, "right") - 1
            for place, doc in zip(at.tolist(), docs.tolist(), strict=True):
                if place + n <= first[doc + 1]:
                    run = [whole[a:b] for a, b in zip(starts[place : place + n], ends[place : place + n], strict=True)]
                    for item in known[int(grams[place])]:
                        if self.words[item] == run:
                            found[doc].add((place - int(first[doc]), place + n - int(first[doc]), item))
        return counts, {doc: list(x) for doc, x in found.items()}


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known) or not len(x):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _pass(docs: DataFrame, index: Broadcast, id_field: str, last: bool, carried: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pickle.loads(index.value)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                counts, found = known.hits(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                spans, items = [], []
                for k in range(b - a):
                    old = [tuple(x) for x in np.frombuffer(batch.column("__spans")[a + k].as_py(), np.int64).reshape(-1, 2).tolist()] if carried else []
                    names = set(batch.column("__items")[a + k].as_py()) if carried else set()
                    new = found.get(k, [])
                    spans.append(_merged(old + [(x, y) for x, y, _ in new]) if new or old else [])
                    items.append(sorted(names | {known.ids[i] for *_, i in new}))
                ids = batch.column("doc_id").slice(a, b - a)
                if last:
                    hit = [sum(y - x for x, y in s) for s in spans]
                    columns = {"doc_id": ids, "n_words": pa.array(counts, pa.int64()), "n_hit": pa.array(hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64()), "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], "contaminated": [x > 0 for x in hit], "spans": pa.array([[{"first": x, "end": y} for x, y in s] for s in spans], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), "items": pa.array(items, pa.list_(pa.string()))}
                else:
                    columns = {"doc_id": ids, "text": batch.column("text").slice(a, b - a), "__spans": pa.array([np.array(s, np.int64).tobytes() for s in spans], pa.binary()), "__items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_pydict(columns)

    out = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<first: long, end: long>>, items array<string>" if last else f"text string, {_FOUND}"
    return docs.mapInArrow(giving_back(run), f"doc_id {id_field}, {out}")


def document_fingerprints(texts: DataFrame, lengths: list[int], window: int) -> DataFrame:
    """key and print of ``texts`` (key, text): winnowed 5-grams, and all runs of as many words as the short items have (``lengths``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                low, starts, ends, first = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                hashes = word_hashes(low, starts, ends)
                grams = gram_hashes(hashes, GRAM)
                at = _winnowed(grams, first[:-1], first[1:], window)
                found = [(at, grams[at])]
                for n in lengths:
                    grams = gram_hashes(hashes, n)
                    at = np.arange(len(grams))
                    at = at[at + n <= first[np.searchsorted(first, at, "right")]]
                    found.append((at, grams[at]))
                at, prints = (np.concatenate(x) for x in zip(*found, strict=True))
                row = a + np.searchsorted(first, at, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(row)), pa.array(prints.view(np.int64))], names=["key", "print"])

    return texts.mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, print long").distinct()


def item_fingerprints(items: DataFrame, window: int) -> DataFrame:
    """print of ``items`` (item_id, text): what documents that hold a window of them have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                found = ItemIndex(list(zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True)), window).fingerprints()
                yield pa.RecordBatch.from_arrays([pa.array(np.array(sorted(found), np.uint64).view(np.int64))], names=["print"])

    return items.mapInArrow(run, "print long").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of hit words) and items.

    Words: runs of digits, letters (A-Z as a-z) and characters outside ASCII. Hit: a word in an occurrence of ``window``
    consecutive words of an item, or of a whole item that has fewer. Null and empty texts have no words and hit nothing; items
    without words are passed over; an item id that repeats counts once, a null one as 'null'. With no items nothing is hit.
    """
    spark = docs.sparkSession
    item = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    # The blocks are cut by size, not by number of items; one block is at most this much on the driver.
    sized = item.withColumn("__n", F.octet_length("text").cast("long"))
    total = sized.agg(F.sum("__n")).first()[0] or 0
    blocks = max(1, -(-total // (block_windows * 6)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def index_of(part: DataFrame) -> Broadcast:
        return spark.sparkContext.broadcast(pickle.dumps(ItemIndex([(r[0], r[1]) for r in part.select("item_id", "text").toLocalIterator()], window)))

    if blocks == 1:
        return _pass(rows, index_of(sized), kind, True, False)
    words = F.size(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[0-9a-z\x{80}-\x{10FFFF}]+"), F.lit(0)))
    lengths = sorted(r[0] for r in sized.select(words.alias("n")).filter((F.col("n") > 0) & (F.col("n") < window)).distinct().collect())  # under ``window`` of them
    keyed = rows.withColumn("key", text_key(F.col("text")))
    prints = document_fingerprints(keyed.select("key", "text"), lengths, window)
    suspects = materialize(prints.join(item_fingerprints(item, window), "print", "left_semi").select("key").distinct(), "decontamination-suspects")
    clean = _pass(keyed.join(suspects, "key", "left_anti").drop("key"), index_of(sized.limit(0)), kind, True, False)
    rows = keyed.join(suspects, "key", "left_semi").drop("key")
    for k in range(blocks):
        rows = _pass(rows, index_of(sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)), kind, k == blocks - 1, k > 0)
        if k < blocks - 1:
            rows = materialize(rows, "decontamination")
    return clean.unionByName(rows)


def clean_of(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without rows that hold a window of an item. Each row goes by its own text, whatever other rows its id has."""
    keyed = docs.withColumn("__lattica_text", text_key(F.col(text_col)))
    bad = decontaminate(keyed, items, "__lattica_text", text_col).filter("contaminated").select(F.col("doc_id").alias("__lattica_text")).distinct()
    return keyed.join(materialize(bad, "contaminated"), "__lattica_text", "left_anti").select(docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


OP5_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i + 1 : i + least(10, len(w))], ' '))) AS g FROM iw WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, unnest(range(len(w) - n + 1)) AS p, unnest(list_transform(range(len(w) - n + 1), lambda i: array_to_string(w[i + 1 : i + n], ' '))) AS g FROM dw, lens WHERE len(w) >= n),
hit AS (SELECT DISTINCT d.doc_id, d.p, d.n, w.item_id FROM dg d JOIN win w ON d.g = w.g AND d.n = w.n),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
