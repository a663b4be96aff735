"""Exact deduplication by deterministic block naming, with DataFrame functions only.

Every text is cut into blocks of ``block_bytes``. Equal blocks get one integer name: their place in the order of the distinct blocks,
sorted by a 128-bit hash of theirs, so that ranges of the hash are numbered apart. Then adjacent names are paired and the distinct pairs are named the same way, level after level, until one
name is left of each document. Documents with the same number of blocks and the same last name are equal, and no others.

Blocks travel once, as the key of a pre-aggregated grouping by a 128-bit hash. That grouping also compares the contents: where
two blocks of one hash differ, everything is done again with other hash seeds. So a name stands for one content for certain, and
all later joins carry integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.shared import materialize, table

BLOCK_BYTES = 4096
#: Names are numbered within 2**16 ranges of the hash, so that no task sorts all of them.
RANGE_BITS = 16


def _key(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), block).alias("a"), F.xxhash64(F.lit(seed + 1), block, F.octet_length(block)).alias("b"))


def _named(distinct: DataFrame, keys: list[str], spread: Column) -> DataFrame:
    """``keys`` and their name: hash range in the high bits, place in the sorted range in the low ones."""
    part = F.shiftrightunsigned(spread, 64 - RANGE_BITS)
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys))
    return distinct.withColumn("part", part).select(*keys, (F.shiftleft(F.col("part"), 40) + place).alias("name"))


def block_identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: id, text_sha256, n_bytes, n_blocks and name; equal (n_blocks, name) means equal text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    whole = docs.select(F.col(id_col).alias("id"), text.alias("bytes")).withColumn("n_bytes", F.octet_length("bytes").cast("long"))
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n_bytes") / block_bytes)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes)))
    for seed in range(1, 200, 2):
        blocks = whole.select(F.explode(cut).alias("block")).withColumn("key", _key(F.col("block"), seed)).groupBy("key")
        found = materialize(blocks.agg(F.min("block").alias("low"), F.max("block").alias("high")).select("key.a", "key.b", (F.col("low") != F.col("high")).alias("mixed")), "block-keys")
        if found.filter("mixed").isEmpty():
            break
    else:
        raise RuntimeError("no pair of hash seeds separates the blocks")
    keys = F.transform(cut, lambda block: _key(block, seed))
    rows = materialize(whole.select(F.monotonically_increasing_id().alias("row"), "id", F.sha2("bytes", 256).alias("text_sha256"), "n_bytes", n_blocks.alias("n_blocks"), keys.alias("keys")), "block-rows")
    names = _named(found, ["a", "b"], F.col("a"))
    level = rows.select("row", "n_blocks", F.posexplode("keys").alias("place", "key")).select("row", "n_blocks", "place", "key.a", "key.b").join(names, ["a", "b"])
    level = materialize(level.select("row", "n_blocks", "place", "name"), "block-names")
    last, longest = level.filter("n_blocks = 1").select("row", "name"), rows.agg(F.max("n_blocks")).first()[0] or 1
    level, several = level.filter("n_blocks > 1").drop("n_blocks"), longest > 1
    while longest > 1:
        sides = [F.max(F.when(F.col("place") % 2 == side, F.col("name"))).alias(as_) for side, as_ in ((0, "a"), (1, "b"))]
        pairs = level.groupBy("row", F.floor(F.col("place") / 2).cast("int").alias("place")).agg(*sides).withColumn("b", F.coalesce("b", F.lit(-1)))
        pairs = materialize(pairs, "block-pairs")
        names = _named(pairs.select("a", "b").distinct(), ["a", "b"], F.xxhash64("a", "b"))
        level = materialize(pairs.join(names, ["a", "b"]).select("row", "place", "name"), "block-names")
        longest = (longest + 1) // 2
    return rows.drop("keys").join(last.unionByName(level.select("row", "name")) if several else last, "row")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_bytes.

    Texts are equal when identical; null counts as empty. The largest id of a group stays; a null id counts as the smallest.
    Rows that repeat both id and text are one group: exactly one of them is kept. An empty table gives no rows; other columns,
    whatever their names, are ignored.
    """
    named = materialize(block_identities(docs, id_col, text_col, block_bytes), "block-identity")
    best = F.max(F.struct("id", "row", "text_sha256", "n_bytes"))
    groups = named.groupBy("n_blocks", "name").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    alone = groups.filter("group_size = 1").select(F.col("best.id").alias("doc_id"), F.col("best.id").alias("keep_id"), "group_size", F.lit(True).alias("kept"), "best.text_sha256", "best.n_bytes")
    # Only rows of larger groups are joined, dealt over 32 salts, so that a huge group is not one task.
    several = groups.filter("group_size > 1").select("n_blocks", "name", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("salt"))
    rest = named.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(32)).cast("int")).join(several, ["n_blocks", "name", "salt"])
    return alone.unionByName(rest.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "n_bytes"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    found = materialize(exact_dedup(docs, id_col, text_col), "exact-dedup")
    keys = F.col(id_col), F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    kept = found.filter("kept").select(F.col("doc_id").alias("__lattica_id"), F.col("text_sha256").alias("__lattica_sha"))
    dropped = found.filter("NOT kept").select(F.col("doc_id").alias("__lattica_id"), F.col("text_sha256").alias("__lattica_sha"))
    away = dropped.distinct()
    ties = materialize(away.join(kept, (away["__lattica_id"].eqNullSafe(kept["__lattica_id"])) & (away["__lattica_sha"] == kept["__lattica_sha"]), "left_semi"), "exact-ties")
    marked = docs.withColumns({"__lattica_doc": keys[0], "__lattica_text": keys[1]})
    match = lambda right: marked["__lattica_doc"].eqNullSafe(right["__lattica_id"]) & (marked["__lattica_text"] == right["__lattica_sha"])
    out = marked.join(away, match(away), "left_anti")
    if not ties.isEmpty():  # rows that repeat id and text: one of each stays
        out = out.unionByName(marked.join(ties, match(ties), "left_semi").dropDuplicates(["__lattica_doc", "__lattica_text"]))
    return out.drop("__lattica_doc", "__lattica_text")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256, CAST(strlen(t) AS BIGINT) AS n_bytes
FROM d
"""
