"""Removal of repeated byte strings by prefix-free parsing.

Rolling hashes over the bytes trigger phrases: of each window of ``LENGTH`` bytes the least hash of its ``GRAM``-byte strings is
taken, and windows that follow one another with the same least hash make a phrase. Neighbouring phrases overlap by ``LENGTH`` - 1 bytes,
so no phrase's windows begin another's, every window starts in exactly one phrase, and where it occurs again it is in a phrase of the
same hash. The corpus is its parse, the sequence of phrases, over the dictionary of different phrases. Up to a depth of ``LENGTH`` bytes,
which is all that is asked for, windows stand in corpus order as they do in the suffix array of the dictionary, each as often as the
parse has its phrase: with this overlap a window never needs the phrase behind its own, so the parse's own suffix array, which orders
what lies deeper, isn't built.

1. Documents are gathered in batches, written once as a table in buckets, so that later joins leave it where it is. A document equal to one of a smaller id is removed whole and takes no part
   in what follows.
2. Each batch says which hashes it has; only hashes that several documents have go on. Most of a text ends here.
3. The distinct phrases of those hashes, with the least id of a document of the batch that has them, are dealt out by hash. Of each
   share the phrases are the dictionary: its suffix array, in the order of ``LENGTH`` bytes, brings equal windows together, and the
   least id of each run of equal windows is compared with that of every phrase of the parse.
4. Each batch gets a bit for each window of its phrases, marks the bytes, and gives a row per document.

Hashes of very many batches (a line that is everywhere) are dealt out window by window, by the windows' own bytes, so that their text
spreads over the shares; equal windows and phrases of one batch are one entry. A share still gets a row of each batch that has one of its
hashes, so the share of such a line grows by some 50 bytes a batch; from 100 GB on batches grow with the corpus, up to 16 MB, which
leaves 0.3 GB for that share at 100 TB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.shared import bucketed, chunks, materialize, table, utf8
from lattica.llm.words import mixed, sliding_min

LENGTH = 50
#: A multiple of 8. Longer ones are shared by chance less often, shorter ones make fewer phrases.
GRAM = 24
#: Text of a batch, and how much it may grow to so that a corpus has no more than so many batches.
BATCH_BYTES, LARGEST_BATCH, BATCHES = 1 << 20, 16 << 20, 100_000
#: A hash that so many batches have is dealt out by single windows.
COMMON_FROM = 200
#: Text per share of phrases, and least number of shares.
SHARE_BYTES, LEAST_SHARES = 2 << 20, 256
#: Text per bucket of the table of batches.
BUCKET_BYTES = 32 << 20
_NO_ID = np.iinfo(np.int64).max


def batches_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """batch, ids, known (1 where the id is not null), offsets, SHA-256 digests and zstandard-compressed bytes; a document is never divided."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        pack, number = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId() << 32
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids = batch.column("id")
            for a, b in chunks(offsets, batch_bytes):
                known = ids.slice(a, b - a).is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
                values = ids.slice(a, b - a).fill_null(_NO_ID).to_numpy().astype("<i8")
                at, raw = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]].tobytes()
                digests = b"".join(hashlib.sha256(raw[x:y]).digest() for x, y in zip(at, at[1:], strict=False))
                part = [number, values.tobytes(), known.tobytes(), at.astype("<i8").tobytes(), digests, pack.compress(raw)]
                yield pa.RecordBatch.from_arrays([pa.array([part[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in part[1:])], names=["batch", "ids", "known", "offsets", "digests", "data"])
                number += 1

    return rows.mapInArrow(run, "batch long, ids binary, known binary, offsets binary, digests binary, data binary")


def _unpacked(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    import zstandard

    ids, known, offsets = (np.frombuffer(batch.column(c)[k].as_py(), t) for c, t in (("ids", "<i8"), ("known", np.uint8), ("offsets", "<i8")))
    return ids, known, offsets, zstandard.ZstdDecompressor().decompress(batch.column("data")[k].as_py(), max_output_size=int(offsets[-1]) + 1)


def _digests(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.frombuffer(batch.column("digests")[k].as_py(), "S32")


def _least_by(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the least id of each, and which key each row has."""
    values, inverse = np.unique(keys, return_inverse=True)
    least = np.full(len(values), _NO_ID)
    np.minimum.at(least, inverse, ids)
    return values, least, inverse


def digests_by_share(batches: DataFrame, shares: int) -> DataFrame:
    """share, batch, digests and least: the distinct digests of each batch and the least id of each."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                values, least, _ = _least_by(_digests(batch, k), np.frombuffer(batch.column("ids")[k].as_py(), "<i8"))
                parts = list(_by_share(_dealt(values.view("<u8")[::4], shares)))
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int64()), pa.array([batch.column("batch")[k].as_py()] * len(parts), pa.int64()), *(pa.array([x[i].tobytes() for _, i in parts], pa.binary()) for x in (values, least))], names=["share", "batch", "digests", "least"])

    return batches.select("batch", "ids", "digests").mapInArrow(run, "share long, batch long, digests binary, least binary")


def _smaller_elsewhere(key: tuple, rows: pa.Table) -> pa.Table:
    """Of one share: for each batch the digests of which another batch has a smaller id, and that id."""
    digests, ids = ([np.frombuffer(x.as_py(), t) for x in rows.column(c)] for c, t in (("digests", "S32"), ("least", "<i8")))
    _, least, inverse = _least_by(np.concatenate(digests), np.concatenate(ids))
    out, at = [], 0
    for number, own, low in zip(rows.column("batch").to_pylist(), digests, ids, strict=True):
        best, at = least[inverse[at : at + len(own)]], at + len(own)
        if (other := best < low).any():
            out.append((number, own[other].tobytes() + best[other].tobytes()))
    return pa.table({"batch": pa.array([a for a, _ in out], pa.int64()), "share": pa.array([-2] * len(out), pa.int64()), "info": pa.array([b for _, b in out], pa.binary())})


def _copies(batch: pa.RecordBatch, k: int, ids: np.ndarray, infos: list) -> np.ndarray:
    """Which documents of a batch are equal to one of a smaller id."""
    values, least, inverse = _least_by(_digests(batch, k), ids)
    for x in infos:
        if x["share"] == -2:
            n = len(x["info"]) // 40
            at = np.searchsorted(values, np.frombuffer(x["info"], "S32", n))
            least[at] = np.minimum(least[at], np.frombuffer(x["info"], "<i8", n, 32 * n))
    return least[inverse] < ids


def phrases_of(data: bytes, offsets: np.ndarray, without: np.ndarray | None = None, piece: int = BATCH_BYTES // 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and hash (even) of each phrase. Windows do not cross documents; documents ``without`` have none."""
    n, out = len(data) - LENGTH + 1, []
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.zeros(n + 1, np.int32)
    long = np.diff(offsets) >= LENGTH
    if without is not None:
        long &= ~without
    inside[offsets[:-1][long]] += 1
    inside[offsets[1:][long] - LENGTH + 1] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    for at in range(0, n, piece):
        size = min(piece, n - at)
        words = np.ndarray((size + LENGTH - 8,), "<u8", buffer=data, offset=at, strides=(1,))
        grams = np.zeros(size + LENGTH - GRAM, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(0, GRAM, 8):
                grams = mixed(grams * np.uint64(0x9E3779B97F4A7C15) ^ words[k : k + len(grams)])
        low = sliding_min(grams, LENGTH - GRAM + 1) & ~np.uint64(1)
        valid = inside[at : at + size]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
        stop = valid.copy()
        stop[:-1] &= ~valid[1:] | (low[1:] != low[:-1])
        first, last = np.flatnonzero(new), np.flatnonzero(stop)
        out.append((first + at, last - first + 1, low[first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _dealt(hashes: np.ndarray, shares: int) -> np.ndarray:
    return (mixed(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(shares)).astype(np.int64)


def _by_share(share: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(share, kind="stable")
    edges = np.flatnonzero(np.diff(share[order])) + 1
    for part in np.split(order, edges):
        if len(part):
            yield int(share[part[0]]), part


def hashes_by_share(batches: DataFrame, shares: int) -> DataFrame:
    """share, batch and hashes: the distinct phrase hashes of each batch, with the last bit set where two documents of it have one."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                ids, _, offsets, data = _unpacked(batch, k)
                first, _, hashes = phrases_of(data, offsets, _copies(batch, k, ids, batch.column("infos")[k].as_py() or []))
                doc = ids[np.searchsorted(offsets, first, "right") - 1]
                order = np.argsort(hashes, kind="stable")
                hashes, doc = hashes[order], doc[order]
                edges = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
                if len(edges):
                    several = np.minimum.reduceat(doc, edges) < np.maximum.reduceat(doc, edges)
                    found = hashes[edges] | several.astype(np.uint64)
                    parts = list(_by_share(_dealt(hashes[edges], shares)))
                    number = batch.column("batch")[k].as_py()
                    yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in parts], pa.int64()), pa.array([number] * len(parts), pa.int64()), pa.array([found[p].tobytes() for _, p in parts], pa.binary())], names=["share", "batch", "hashes"])

    return batches.mapInArrow(run, "share long, batch long, hashes binary")


def _shared_hashes(key: tuple, rows: pa.Table) -> pa.Table:
    """Of one share: for each batch the hashes that some other document has too, with the last bit set where very many batches have them."""
    each = [np.frombuffer(x.as_py(), np.uint64) for x in rows.column("hashes")]
    together = np.concatenate(each)
    values, inverse, counts = np.unique(together & ~np.uint64(1), return_inverse=True, return_counts=True)
    flagged = np.zeros(len(values), bool)
    flagged[inverse[(together & np.uint64(1)) > 0]] = True
    keep, common = flagged | (counts > 1), counts >= COMMON_FROM
    out, at = [], 0
    for number, x in zip(rows.column("batch").to_pylist(), each, strict=True):
        i = inverse[at : at + len(x)]
        i, at = i[keep[i]], at + len(x)
        if len(i):
            out.append((number, (values[i] | common[i].astype(np.uint64)).tobytes()))
    return pa.table({"batch": pa.array([a for a, _ in out], pa.int64()), "share": pa.array([-1] * len(out), pa.int64()), "info": pa.array([b for _, b in out], pa.binary())})


class Parse:
    """The phrases of a batch whose hashes are shared, as distinct strings by share, always in the same order."""

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, data: bytes, copies: np.ndarray, shared: np.ndarray, shares: int):
        first, count, hashes = phrases_of(data, offsets, copies)
        known = np.sort(shared)
        plain = known & ~np.uint64(1)
        at = np.minimum(np.searchsorted(plain, hashes), max(0, len(plain) - 1))
        hit = (plain[at] == hashes) if len(plain) else np.zeros(len(hashes), bool)
        first, count, hashes, common = first[hit], count[hit], hashes[hit], (known[at[hit]] & np.uint64(1)) > 0 if len(plain) else hit[hit]
        share = _dealt(hashes, shares)
        if common.any():  # phrases of very common hashes: window by window, dealt by both ends of the window
            many = count[common]
            start = np.repeat(first[common], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            words = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
            own = _dealt(mixed(words[start]) ^ words[start + LENGTH - 8], shares)
            first, count, share = np.concatenate([first[~common], start]), np.concatenate([count[~common], np.ones(len(start), np.int64)]), np.concatenate([share[~common], own])
        self.first, self.count, self.share = first, count, share
        self.doc = ids[np.searchsorted(offsets, first, "right") - 1]
        #: Per share: strings, least ids, and for each phrase of the share (``where``) the number of its string.
        self.parts: list[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]] = []
        starts, ends = first.tolist(), (first + count + LENGTH - 1).tolist()
        for s, where in _by_share(share):
            numbers: dict[bytes, int] = {}
            which = np.array([numbers.setdefault(data[starts[i] : ends[i]], len(numbers)) for i in where.tolist()])
            least = np.full(len(numbers), _NO_ID)
            np.minimum.at(least, which, self.doc[where])
            self.parts.append((s, list(numbers), least, where, which))


def phrases_by_share(batches: DataFrame, shares: int) -> DataFrame:
    """share, batch, sizes, least and strings of the distinct shared phrases of ``batches`` (with ``infos``)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                ids, _, offsets, data = _unpacked(batch, k)
                infos = batch.column("infos")[k].as_py() or []
                parts = Parse(ids, offsets, data, _copies(batch, k, ids, infos), _joined(infos), shares).parts
                for at in range(0, len(parts), 500):
                    some = parts[at : at + 500]
                    columns = [[p[0] for p in some], [batch.column("batch")[k].as_py()] * len(some), [np.array([len(x) for x in p[1]], "<u4").tobytes() for p in some], [p[2].tobytes() for p in some], [b"".join(p[1]) for p in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["share", "batch", "sizes", "least", "strings"])

    return batches.mapInArrow(run, "share long, batch long, sizes binary, least binary, strings binary")


def _joined(infos: list) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x["info"], np.uint64) for x in infos if x["share"] == -1)])


def earlier_windows(sizes: np.ndarray, least: np.ndarray, strings: bytes) -> np.ndarray:
    """For each window of the dictionary's strings (in order) the least id of any string with an equal window, by its suffix array."""
    counts = sizes.astype(np.int64) - LENGTH + 1
    begins = np.cumsum(sizes.astype(np.int64)) - sizes
    starts = np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    windows = np.ndarray((len(strings) - LENGTH + 1,), f"S{LENGTH}", buffer=strings, strides=(1,))[starts]
    order = np.argsort(windows, kind="stable")
    windows = windows[order]
    edges = np.flatnonzero(np.concatenate([[True], windows[1:] != windows[:-1]]))
    ids = np.repeat(least, counts)[order]
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(ids, edges), np.diff(np.append(edges, len(order))))
    return out


def _verdicts(key: tuple, rows: pa.Table) -> pa.Table:
    """Of one share: for each batch a bit for each window of its strings, set where a smaller id than the string's least has it."""
    numbers: dict[bytes, int] = {}
    parse, least = [], []
    for sizes, ids, strings in zip(rows.column("sizes"), rows.column("least"), rows.column("strings"), strict=True):
        sizes, ids, strings = np.frombuffer(sizes.as_py(), "<u4"), np.frombuffer(ids.as_py(), "<i8"), strings.as_py()
        ends = np.cumsum(sizes).tolist()
        which = np.array([numbers.setdefault(strings[a:b], len(numbers)) for a, b in zip([0, *ends], ends, strict=False)])
        parse.append((which, ids, sizes.astype(np.int64) - LENGTH + 1))
        least.append(ids)
    which = np.concatenate([p[0] for p in parse])
    low = np.full(len(numbers), _NO_ID)
    np.minimum.at(low, which, np.concatenate(least))
    sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
    found = earlier_windows(sizes, low, b"".join(numbers))
    begins = np.cumsum(sizes - LENGTH + 1) - (sizes - LENGTH + 1)
    out = []
    for number, (which, ids, counts) in zip(rows.column("batch").to_pylist(), parse, strict=True):
        at = np.repeat(begins[which] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        bits = found[at] < np.repeat(ids, counts)
        if bits.any():
            out.append((number, np.packbits(bits).tobytes()))
    share = key[0].as_py()
    return pa.table({"batch": pa.array([a for a, _ in out], pa.int64()), "share": pa.array([share] * len(out), pa.int64()), "info": pa.array([b for _, b in out], pa.binary())})


def _marked(ids: np.ndarray, offsets: np.ndarray, data: bytes, copies: np.ndarray, infos: list, shares: int) -> np.ndarray:
    """Which bytes of a batch are removed."""
    parse = Parse(ids, offsets, data, copies, _joined(infos), shares)
    bits = {x["share"]: x["info"] for x in infos if x["share"] >= 0}
    change = np.zeros(len(data) + 1, np.int32)
    for share, strings, least, where, which in parse.parts:
        counts = np.array([len(x) for x in strings], np.int64) - LENGTH + 1
        begins = np.cumsum(counts) - counts
        got = np.unpackbits(np.frombuffer(bits[share], np.uint8), count=int(counts.sum())).astype(bool) if share in bits else np.zeros(int(counts.sum()), bool)
        n = parse.count[where]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = np.repeat(parse.doc[where] > least[which], n) | got[np.repeat(begins[which], n) + nth]
        windows = (np.repeat(parse.first[where], n) + nth)[gone]
        np.add.at(change, windows, 1)
        np.add.at(change, windows + LENGTH, -1)
    whole = copies & (np.diff(offsets) >= LENGTH)
    np.add.at(change, offsets[:-1][whole], 1)
    np.add.at(change, offsets[1:][whole], -1)
    return np.cumsum(change[:-1]) > 0


def _numbers(ids: DataFrame) -> DataFrame:
    """(id, number) of the distinct non-null values of ``ids`` (id): whole numbers in the order of the ids.

    Ranges of ids are numbered apart, each from what the ranges before it hold; only their counts reach the driver.
    """
    spark = ids.sparkSession
    ranged = ids.filter("id IS NOT NULL").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "id-ranges")
    counts, begins, total = ranged.groupBy("part").count().orderBy("part").collect(), [], 0  # one for each partition
    for part, n in counts:
        begins.append((part, total))
        total += n
    place = F.row_number().over(Window.partitionBy("part").orderBy("id"))
    return ranged.join(F.broadcast(spark.createDataFrame(begins, "part int, begin long")), "part").select("id", (F.col("begin") + place).alias("number"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and ``kept`` (binary) if asked for.

    Removed is each byte covered by a string of 50 bytes that also starts in a document of a smaller id. Null and empty texts have
    no bytes; documents that repeat an id count as one and take nothing from one another; a null id counts as the largest. Ids of any
    type that has an order will do; those that are no whole numbers are numbered first. Needs memory in proportion to the longest document.
    """
    spark = docs.sparkSession
    if docs.schema[id_col].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        numbers = materialize(_numbers(docs.select(F.col(id_col).alias("id"))), "id-numbers")
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(numbers, "id", "left").select(F.col("number").alias("doc_id"), "text")
        out = remove_repeats(rows, with_kept=with_kept)
        return out.join(numbers.withColumnRenamed("number", "doc_id"), "doc_id", "left").drop("doc_id").withColumnRenamed("id", "doc_id").select("doc_id", *out.columns[1:])
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    batch_bytes = min(LARGEST_BATCH, max(BATCH_BYTES, total // BATCHES))
    base = bucketed(batches_of(docs, id_col, text_col, batch_bytes), "batches", "batch", total // BUCKET_BYTES)
    shares = max(LEAST_SHARES, total // SHARE_BYTES)
    kind = "batch long, share long, info binary"

    def told(rows: DataFrame) -> DataFrame:
        """The batches with what has been found out about each, which is bounded by its bytes."""
        infos = rows.groupBy(F.col("batch").alias("of")).agg(F.collect_list(F.struct("share", "info")).alias("infos"))
        return base.join(infos, F.col("batch") == F.col("of"), "left").drop("of")

    copies = materialize(digests_by_share(base, shares).groupBy("share").applyInArrow(_smaller_elsewhere, kind), "copies")
    shared = materialize(hashes_by_share(told(copies), shares).groupBy("share").applyInArrow(_shared_hashes, kind), "shared-hashes")
    found = materialize(phrases_by_share(told(copies.unionByName(shared)), shares).groupBy("share").applyInArrow(_verdicts, kind), "verdicts")
    last = told(copies.unionByName(shared).unionByName(found))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                ids, known, offsets, data = _unpacked(batch, k)
                infos = batch.column("infos")[k].as_py() or []
                gone = _marked(ids, offsets, data, _copies(batch, k, ids, infos), infos, shares)
                raw, out = np.frombuffer(data, np.uint8), []
                for a, b in zip(offsets.tolist(), offsets.tolist()[1:], strict=False):
                    x = gone[a:b]
                    kept = data[a:b] if not x.any() else raw[a:b][~x].tobytes()
                    out.append((b - a, b - a - len(kept), int(x[:1].sum() + (x[1:] & ~x[:-1]).sum()), hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(ids, mask=known == 0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())] + [pa.array(columns[4], pa.binary())] * with_kept
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_kept)

    return last.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
