"""SimHash near-deduplication with pivot distance tables.

Fingerprints: 64 bits, by majority over the XXH64 hashes of word shingles. Equal fingerprints are one node. For each distinct
fingerprint a table holds its Hamming distances to ``PIVOTS`` fixed reference fingerprints. By the triangle inequality two
fingerprints at most ``radius`` bits apart differ by at most ``radius`` in every coordinate, so pairs whose largest coordinate
difference is more are discarded and the rest are verified on all bits. The first coordinate keeps most other pairs from being formed.

Pairs come from fingerprints that agree on enough of their bit blocks (radius + 1 blocks or more, of which all but ``radius``
agree), in groups of at most ``group_limit``. The members of larger groups are linked in another exact way with rows in
proportion to their number: each is listed under itself and all its one-bit neighbours; two fingerprints share an entry just
when they are at most two bits apart, and an entry has 65 members at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.components import components
from lattica.llm.shared import LOWER, materialize, table, text_key

SHINGLE = 3
RADIUS = 2
SEED = 42
PIVOTS = 16
GROUP_LIMIT = 64


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Of a whole text: lower-case A-Z, words between ASCII white space, shingles with repeats, majority of each hash bit."""
    from xxhash import xxh64_intdigest

    words = text.translate(LOWER).split()
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), seed)]
        ones += np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little")
    else:
        joined = b" ".join(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        stops = np.cumsum(lengths)
        starts, ends = (stops - lengths)[:n].tolist(), (stops - 1)[shingle - 1 :].tolist()
        for at in range(0, n, 1 << 16):
            hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)), np.uint64, min(1 << 16, n - at))
            ones += _bit_counts(hashes)
    bits = 2 * ones > n
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, added up eight lanes of a byte at a time."""
    out, one = np.zeros(64, np.int64), np.uint64(0x0101010101010101)
    for bit in range(8):
        lanes = (hashes >> np.uint64(bit)) & one
        out[bit::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64) if len(lanes) < 255 else _lanes(lanes)
    return out


def _lanes(lanes: np.ndarray) -> np.ndarray:
    cut = len(lanes) // 255 * 255
    sums = lanes[:cut].reshape(-1, 255).sum(axis=1, dtype=np.uint64)  # 255 ones at most in each byte
    rest = lanes[cut:].sum(dtype=np.uint64)
    return np.append(sums, rest).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long); null and wordless texts have 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x.as_py(), shingle, seed) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def pivots(count: int = PIVOTS) -> list[int]:
    """Reference fingerprints, as signed longs, from a fixed random sequence."""
    return [int(x) for x in np.random.default_rng(64).integers(-(1 << 63), 1 << 63, count, np.int64)]


def _blocks(fp: Column, blocks: int, radius: int) -> list[Column]:
    """A key for each choice of ``blocks - radius`` bit blocks; fingerprints within ``radius`` share one of them at least."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    out = []
    for k, chosen in enumerate(combinations(masks, blocks - radius)):
        mask = sum(chosen)
        out.append(F.struct(F.lit(k).alias("table"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))
    return out


def pairs_to_verify(members: DataFrame, radius: int, count: int = PIVOTS) -> DataFrame:
    """Pairs (a, b) of ``members`` (group, fp) of one group that ``count`` pivots don't discard, each with one row for each group they share.

    The first pivot decides which pairs are formed at all: members are joined by group and by a cell of radius + 1 distances, the one
    nearer to the pivot listed under its own cell and the next. The other pivots discard what is formed before any bits are compared.
    """
    names = [f"p{k}" for k in range(count)]
    rows = members.withColumns({n: F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("int") for n, p in zip(names, pivots(count), strict=True)})
    if not names:
        return rows.alias("x").join(rows.alias("y"), (F.col("x.group") == F.col("y.group")) & (F.col("x.fp") < F.col("y.fp"))).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    cell = F.floor(F.col("p0") / (radius + 1))
    x, y = rows.withColumn("cell", F.explode(F.array(cell, cell + 1))).alias("x"), rows.withColumn("cell", cell).alias("y")
    order = (F.col("x.p0") < F.col("y.p0")) | (F.col("x.p0") == F.col("y.p0")) & (F.col("x.fp") < F.col("y.fp"))
    formed = x.join(y, (F.col("x.group") == F.col("y.group")) & (F.col("x.cell") == F.col("y.cell")) & order)
    far = F.greatest(F.lit(0), *(F.abs(F.col(f"x.{n}") - F.col(f"y.{n}")) for n in names))
    return formed.filter(far <= radius).select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b"))


def links(distinct: DataFrame, radius: int = RADIUS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (a, b) that connect all fingerprints of ``distinct`` (fp) at most ``radius`` (0 to 2) bits apart."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    count = distinct.count()
    blocks = radius + (1 if count < 1 << 21 else 2 if count < 1 << 32 else 3)  # so that keys outnumber fingerprints
    keyed = materialize(distinct.select("fp", F.explode(F.array(*_blocks(F.col("fp"), blocks, radius))).alias("group")), "pivot-table")
    sizes = keyed.groupBy("group").count().filter("count > 1")
    small = materialize(keyed.join(sizes.filter(F.col("count") <= group_limit).select("group"), "group"), "pivot-groups")
    found = pairs_to_verify(small, radius).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    large = materialize(keyed.join(sizes.filter(F.col("count") > group_limit).select("group"), "group", "left_semi").select("fp").distinct(), "large-groups")
    around = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)))
    entries = large.select("fp", F.explode(around).alias("entry"))
    if radius == 2:
        met = entries.groupBy("entry").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)  # 65 members at most
        chained = met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    else:
        chained = entries.join(large.withColumnRenamed("fp", "other"), F.col("entry") == F.col("other")).filter(f"fp < other AND {radius} = 1").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    return found.unionByName(chained).distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest id reachable over links.

    Documents link when their fingerprints differ in ``radius`` bits at most. Null, empty and wordless texts have fingerprint 0
    and link like any other; rows that repeat are in one component; a null id never names a component unless all its ids are null.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(links(nodes.select("fp"), radius, group_limit))
    linked = nodes.join(roots, F.col("fp") == F.col("node")).select("fp", "root", "low")
    least = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    of = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    of = of.unionByName(nodes.join(roots, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("low").alias("component_id")))
    of = materialize(of, "components")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies, that with the smallest id; a null id counts as the largest.

    Near copies have five-word shingles of a similarity of 0.8 or more (``near_copies``), or are connected by such.
    Rows are told apart by id and text, so that rows of one id, null or not, go by their own texts. Of rows of the smallest id
    that is of the least text hash, and one of rows that repeat both.
    """
    from lattica.llm.near_copies import near_copies

    marked = docs.withColumns({"__lattica_id": F.col(id_col), "__lattica_text": text_key(F.col(text_col))})
    groups = near_copies(marked.select(F.col("__lattica_text").alias("key"), F.col(text_col).alias("text"))).select(F.col("key").alias("__lattica_text"), F.col("component").alias("component_id"))
    rows = materialize(marked.select("__lattica_id", "__lattica_text").join(materialize(groups, "near-groups"), "__lattica_text"), "near-rows")
    first = F.min(F.struct(F.col("__lattica_id").isNull().alias("last"), F.col("__lattica_id").alias("id"), F.col("__lattica_text").alias("text")))
    best = rows.groupBy("component_id").agg(first.alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    several = materialize(rows.join(best, "component_id").select("__lattica_id", "__lattica_text", (F.col("__lattica_id").eqNullSafe(F.col("best.id")) & (F.col("__lattica_text") == F.col("best.text"))).alias("kept")), "near-several")
    named = lambda x: x.select(F.col("__lattica_id").alias("__id"), F.col("__lattica_text").alias("__text"))
    away = materialize(named(several.filter("NOT kept").select("__lattica_id", "__lattica_text").distinct()), "near-dropped")
    ties = materialize(named(several.filter("kept").groupBy("__lattica_id", "__lattica_text").count().filter("count > 1")), "near-ties")
    match = F.col("__lattica_id").eqNullSafe(F.col("__id")) & (F.col("__lattica_text") == F.col("__text"))
    out = marked.join(away, match, "left_anti")
    if not ties.isEmpty():
        tied = out.join(ties, match, "left_semi").dropDuplicates(["__lattica_id", "__lattica_text"])
        out = out.join(ties, match, "left_anti").unionByName(tied)
    return out.select(docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
