"""What the operators share: tables in the cluster's shared folder, the label split and Arrow text buffers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Upper-case A-Z to lower case; every other byte stays.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of words: digits, a-z and everything outside ASCII.
WORD_BYTE = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
CHUNK_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lattica/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what is written inside as soon as it is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither recompute it nor depend on one executor's disk."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _tidy(spark):
        df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, column: str, least: int) -> DataFrame:
    """``df`` as a table in the shared folder in at least ``least`` buckets by ``column``: joins on it shuffle only their other side."""
    spark = df.sparkSession
    count = max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    table_name = f"lattica_{name}_{uuid.uuid4().hex}"
    with _tidy(spark):
        df.repartition(count, column).write.option("compression", "uncompressed").option("path", new_path(spark, name)).bucketBy(count, column).saveAsTable(table_name)
    return spark.table(table_name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """What rows of one text share, whatever their ids: the SHA-256 of the text, null as empty."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sampled_texts(docs: DataFrame, keys: DataFrame, group: str, per_group: int) -> DataFrame:
    """doc_id, text and ``group``: at most ``per_group`` texts of each value of ``group`` in ``keys`` (doc_id, group), chosen by a hash of the id.

    An id counts once, with its least group and the least of its texts. So ``per_group`` times the number of groups bounds what is
    broadcast and what reaches the driver. A group of fewer ids gives all of them.
    """
    hashed = F.xxhash64("doc_id")
    keys = keys.groupBy("doc_id").agg(F.min(group).alias(group))
    counts = keys.groupBy(F.col(group).alias("__of")).agg(F.count(F.lit(1)).alias("__n"))
    # More than twice as many as are wanted come through, evenly over the hashes, so that ranking them is no large task.
    # The counts are a row for each value, far fewer than the sample that is broadcast below.
    few = keys.join(F.broadcast(counts), F.col(group) == F.col("__of")).filter(F.pmod(hashed, F.lit(1_000_000)) < 1_000_000 * (2.0 * per_group + 20) / F.col("__n"))
    by_hash = Window.partitionBy(group).orderBy(hashed, "doc_id")
    chosen = few.select("doc_id", group).withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= per_group).drop("rank")
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", group).agg(F.min("text").alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of an Arrow string or binary array; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if starts and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes each; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def give_back() -> None:
    """Memory that is free but kept by this process, by Arrow's pool and the C library, goes back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` of mapInArrow, and at the end of each task ``give_back``: Spark keeps the worker beside the tasks of later steps."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
