"""Best-fit-decreasing packing of tokenised documents into sequences, with a segment tree over remaining capacities.

Lengths are whole numbers up to the capacity, so pieces of one length are interchangeable: best-fit decreasing is worked out on
the histogram of lengths, with a number of open bins for each remaining capacity at the leaves of a segment tree that finds the
tightest fitting one in logarithmic time. Runs of equal pieces that go into equal bins are placed in one step, so the plan has
a few rules for each pair of length and capacity, whatever the number of documents. Each rule gives a range of ranks within a
length, a first bin and an offset. The pieces are then ranked within their length in a distributed way, and look their bin up.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.shared import giving_back, materialize, table

CAPACITY = 2048
#: Bytes of the strings without white space, and of their ids, that a Python worker remembers.
REMEMBERED_BYTES = 90 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Ids(dict):
    """Ids by string; those beyond what is remembered come from ``more``."""

    more: dict[str, bytes]

    def __missing__(self, word: str) -> bytes:
        return self.more[word]


class Encoder:
    """Token ids as little-endian bytes. Texts are cut at plain white space, which no token of this tokenizer spans, and the ids of the strings in between are remembered, up to ``REMEMBERED_BYTES`` of both.

    A full stop or comma behind a letter is parted from it by the tokenizer, so of new strings that end so only what stands before is encoded.
    """

    #: Stands between strings that are encoded together; strings with this character go by themselves.
    BETWEEN = "\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # each task has one core
        self.tokenizer, self.known, self.held = Tokenizer.from_file(path), _Ids({"": b""}), 0
        (self.between,) = self.tokenizer.encode(self.BETWEEN, add_special_tokens=False).ids
        self.ends = {end: np.array(self.tokenizer.encode(end, add_special_tokens=False).ids, "<u4").tobytes() for end in ".,"}
        self.parted = all(self.tokenizer.encode(x, add_special_tokens=False).ids == [*self.tokenizer.encode("aé", add_special_tokens=False).ids, *self.tokenizer.encode(x[2:], add_special_tokens=False).ids] for x in ("aé.", "aé,"))

    def _new(self, words: list[str], together: int = 200) -> Iterator[tuple[str, bytes]]:
        plain = [w for w in words if self.BETWEEN not in w]
        groups = [plain[at : at + together] for at in range(0, len(plain), together)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([f" {self.BETWEEN} ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cuts, raw = np.flatnonzero(ids == self.between), ids.tobytes()
            yield from zip(group, [raw[a:b] for a, b in zip([0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)], strict=True)], strict=True)
        for w in words:
            if self.BETWEEN in w:
                yield w, np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        known = self.known
        known.more = {}
        missing = set().union(*split).difference(known)
        if missing:
            ended = [w for w in missing if w.endswith((".", ",")) and w[-2:-1].lower().isalpha()] if self.parted else []
            found = dict(self._new(list({w[:-1] for w in ended}.union(missing.difference(ended)).difference(known))))
            for w in ended:
                found[w] = (found[w[:-1]] if w[:-1] in found else known[w[:-1]]) + self.ends[w[-1]]
            size = sum(map(len, found)) + sum(map(len, found.values())) + 200 * len(found)  # what both objects and their entry take besides
            if self.held + size <= REMEMBERED_BYTES:
                self.held += size
                known.update(found)
            else:
                known.more = found
        return [b"".join(map(known.__getitem__, words)) for words in split]


@functools.cache
def _encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


class CapacityTree:
    """Open bins by remaining capacity; ``tightest(n)`` is the least capacity of at least ``n`` that some bin has."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.used = bytearray(2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.size
        self.used[at] = is_open
        while at > 1:
            at //= 2
            self.used[at] = self.used[2 * at] | self.used[2 * at + 1]

    def tightest(self, need: int) -> int | None:
        at = need + self.size
        while not self.used[at]:
            while at & 1:  # climb while a right child: everything to the right is above
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.size:
            at = 2 * at + (not self.used[2 * at])
        return at - self.size


def best_fit_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rules (length, first rank, first bin, offset, pieces per bin) of best-fit decreasing, by length and rank.

    The pieces of a rule go to consecutive bins, ``pieces per bin`` neighbours into each.
    """
    tree, bins, rules, made = CapacityTree(capacity), defaultdict(list), [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                break
            first, n = bins[room].pop()
            # A bin just used is the tightest as long as it fits, so it is filled up before the next one.
            each = room // length
            full = min(n, left // each)
            take, size = (full, each) if full else (1, left)
            if take < n:
                bins[room].append((first + take, n - take))
            if not bins[room]:
                tree.set(room, False)
            rules.append((length, rank, first, capacity - room, size))
            if rest := room - size * length:
                bins[rest].append((first, take))
                tree.set(rest, True)
            left, rank = left - take * size, rank + take * size
        each = capacity // length
        for n, size in ((left // each, each), (1, left % each)):
            if n and size:
                rules.append((length, rank, made, 0, size))
                if room := capacity - size * length:
                    bins[room].append((made, n))
                    tree.set(room, True)
                made, rank = made + n, rank + n * size
    return rules


def pieces_of(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. A document is its ids and id 0; null is empty."""
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 400):
                part, out = batch.slice(at, 400), []
                ids = part.column("doc_id").to_pylist()
                for doc_id, raw in zip(ids, encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    raw += b"\0\0\0\0"
                    out += [(doc_id, k, k * capacity, len(p) // 4, zlib.crc32(p)) for k, p in enumerate(raw[i : i + 4 * capacity] for i in range(0, len(raw), 4 * capacity))]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], part.column("doc_id").type), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(giving_back(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence_id and offset in it; sequences are filled from 0 without gaps.

    Null and empty texts are the one id 0. Rows that repeat are packed each on their own. An empty table gives no rows.
    """
    pieces = materialize(pieces_of(docs, tokenizer, capacity, id_col, text_col), "pieces")
    spark = docs.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rules = best_fit_plan(histogram, capacity)
    total = sum(histogram.values())
    # Ranks within a length: at most 4096 groups more than there are lengths, none over a 4096th of all pieces.
    share = max(1, total // 4096)
    groups = spark.createDataFrame([(int(n), max(1, -(-c // share))) for n, c in histogram.items()], "length long, groups long")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("groups"))).drop("groups")
    sizes = dealt.groupBy("length", "group").count()
    before = Window.partitionBy("length").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "group", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(order)).join(F.broadcast(sizes), ["length", "group"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("place") - 1).alias("rank"))
    lengths, ranks, first, offset, each = (np.array(x, np.int64) for x in zip(*rules, strict=True)) if rules else [np.zeros(0, np.int64)] * 5
    keys = np.array(lengths) << 48 | ranks if len(lengths) else lengths
    by_key = np.argsort(keys, kind="stable")
    plan = spark.sparkContext.broadcast([x[by_key] for x in (keys, ranks, first, offset, each)])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks, first, offset, each = plan.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, length << 48 | rank, "right") - 1
            inside = rank - ranks[at]
            more = [pa.array(first[at] + inside // each[at]), pa.array(offset[at] + inside % each[at] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), *more], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
