"""WARC archives: writing captures, reading records, and assembling request, response and metadata records into transactions.

A page becomes three records: a response (or, where an earlier page has the same payload, a revisit without payload), the request
and a metadata record, the latter two naming the first in WARC-Concurrent-To. Files are written by Spark's text writer with the
record separator as line separator, so any file system that Spark knows will do. Reading frames records by Content-Length, from
plain or gzip files of one or many members; a file's compressed content is one value, beyond that no more than a record and a block is
held. So files are bounded by bytes: pages are written by size class, and larger pages go fewer to a file.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.shared import materialize, new_path, table

SAME_FROM = 100
#: Largest payload of a size class, and records of it in a file: 500 MB of payloads at most. The rest has a file for each capture.
CLASSES = [(256 << 10, 6000), (8 << 20, 180)]
#: Concurrent records that one nested row holds; a capture with more has further rows, numbered by ``part``.
RECORDS_PER_ROW = 1000

RECORD = (
    "record_id string, record_type string, concurrent_to array<string>, target_uri string, date string, page_id long, refers_to_page long, content_type string, "
    "http_header string, payload binary, payload_bytes long, payload_digest string, intact boolean"
)


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line breaks within the value become spaces."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))


def _record(kind: str | Column, rid: Column, block: Column, content_type: str, *headers: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: "), kind, F.lit("\r\n"), _header("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), rid, F.lit(">"))), *headers, F.lit(f"Content-Type: {content_type}\r\n"), _header("Content-Length", F.octet_length(block)), F.lit("\r\n"), block)


def _uuid(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws("/", *parts).cast("binary"))
    return F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, first): pages whose payload, of ``SAME_FROM`` bytes or more, a page of a smaller id has too.

    Pages of equal payloads are counted before they are shuffled; only groups of several are joined, dealt over salts.
    """
    rows = pages.select("page_id", "digest").filter(F.col("n_bytes") >= SAME_FROM).filter("page_id IS NOT NULL")
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).filter("first < last").drop("last")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(32)).cast("int"))
    return salted.join(groups, ["digest", "salt"]).filter("page_id > first").select("page_id", "digest", "first").distinct()


def write_pages(pages: DataFrame, path: str) -> None:
    """Archive of page_id, url and html at ``path``: one capture a row; null html is an empty payload."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "n_bytes": F.octet_length("html")})
    known = materialize(revisits(rows), "revisits")
    known = known.withColumnsRenamed({"page_id": "of_page", "digest": "of_digest"})
    rows = rows.join(known, (F.col("page_id") == F.col("of_page")) & (F.col("digest") == F.col("of_digest")), "left")
    rows = rows.withColumn("capture", _uuid(F.lit("capture"), F.col("page_id").cast("string"), F.col("digest"), F.monotonically_increasing_id().cast("string")))
    again = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _header("Content-Length", F.col("n_bytes")), F.lit("\r\n"))
    date = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    common = [_header("WARC-Target-URI", F.col("url")), _header("WARC-Date", date), _header("WARC-Page-ID", F.col("page_id"))]
    concurrent = _header("WARC-Concurrent-To", F.concat(F.lit("<urn:uuid:"), F.col("capture"), F.lit(">")))
    main = _record(
        F.when(again, "revisit").otherwise("response"), F.col("capture"), F.when(again, http).otherwise(F.concat(http, F.col("html"))), "application/http; msgtype=response", *common,
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), _header("WARC-Refers-To-Page-ID", F.col("first")),
        F.when(again, "WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\n").otherwise(""),
    )
    asked = F.concat(F.lit("GET "), F.coalesce(F.regexp_replace("url", r"[\s]+", "%20"), F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n"))
    request = _record("request", _uuid(F.lit("request"), F.col("capture")), asked, "application/http; msgtype=request", *common, concurrent)
    fields = F.concat(_header("payloadBytes", F.col("n_bytes")), _header("payloadDigest", F.col("digest")))
    metadata = _record("metadata", _uuid(F.lit("metadata"), F.col("capture")), fields, "application/warc-fields", *common, concurrent)
    largest, least = rows.agg(F.max("n_bytes")).first()[0] or 0, -1
    for k, (limit, count) in enumerate([*CLASSES, (None, 3)]):
        if k == 0 or largest > least:
            of_size = rows.filter((F.col("n_bytes") > least) & (F.col("n_bytes") <= limit) if limit else F.col("n_bytes") > least)
            records = of_size.select(F.explode(F.array(main, request, metadata)).alias("record"))
            records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", count).text(f"{path}/class={k}")
        least = limit


def _inflated(raw: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The content of a plain or gzip file in blocks; further members follow on, a broken end is left out."""
    if bytes(raw[:2]) != b"\x1f\x8b":
        yield from (bytes(raw[at : at + step]) for at in range(0, len(raw), step))
        return
    at = 0
    while at < len(raw):
        unzip, rest = zlib.decompressobj(wbits=31), b""
        while at < len(raw) and not unzip.eof:
            piece = bytes(raw[at : at + step])
            at += len(piece)
            try:
                yield unzip.decompress(piece)
            except zlib.error:
                return
            rest = unzip.unused_data
        at -= len(rest)
        if not unzip.eof or bytes(raw[at : at + 2]) != b"\x1f\x8b":
            return


def records_of(blocks: Iterator[bytes]) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers (lower-case names) and content of each record. What is not a record is passed over up to the next one; a record whose end is missing is left out."""
    buffer, more = bytearray(), True

    def fill(n: int) -> bool:
        nonlocal more
        while more and len(buffer) < n:
            block = next(blocks, None)
            if block is None:
                more = False
            else:
                buffer.extend(block)
        return len(buffer) >= n

    while fill(8):
        start = buffer.find(b"WARC/1.")
        if start < 0:
            del buffer[: max(0, len(buffer) - 7)]
            if not fill(len(buffer) + 1):
                return
            continue
        del buffer[:start]
        while (end := buffer.find(b"\r\n\r\n")) < 0 and fill(len(buffer) + 1):
            pass
        if end < 0:
            return
        headers: dict[str, list[str]] = {}
        for line in bytes(buffer[:end]).decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = headers.get("content-length", [""])[0]
        if not size.isdigit():
            del buffer[:7]
            continue
        if not fill(end + 4 + int(size)):
            return
        yield headers, bytes(buffer[end + 4 : end + 4 + int(size)])
        del buffer[: end + 4 + int(size)]


def _row(headers: dict[str, list[str]], content: bytes, with_payload: bool) -> tuple:
    one = lambda name: headers.get(name, [None])[0]
    number = lambda x: int(x) if x and x.lstrip("-").isdigit() else None
    kind, said, http = one("warc-type"), one("warc-payload-digest"), None
    said = said[7:].lower() if said and said.lower().startswith("sha256:") else None
    payload: bytes | None = content
    if (one("content-type") or "").startswith("application/http"):
        head, blank, payload = content.partition(b"\r\n\r\n")
        http, payload = head.decode("utf-8", "replace"), payload if blank else b""
    if kind == "revisit":
        size = next((number(v.strip()) for k, _, v in (x.partition(":") for x in (http or "").split("\r\n")) if k.strip().lower() == "content-length"), None)
        payload, digest, intact = None, said, None
    else:
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        intact = None if said is None else said == digest
    return (
        one("warc-record-id"), kind, headers.get("warc-concurrent-to", []), one("warc-target-uri"), one("warc-date"), number(one("warc-page-id")), number(one("warc-refers-to-page-id")),
        one("content-type"), http, payload if with_payload else None, size, digest, intact,
    )


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives at ``path``. payload_bytes and payload_digest are of the full payload: of a revisit, as its headers say. Without ``with_payload`` the payload itself is left null, so that later shuffles carry none."""
    schema = spark.createDataFrame([], RECORD).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for headers, block in records_of(_inflated(memoryview(content.as_buffer()))):
                    rows.append(_row(headers, block, with_payload))
                    held += len(block) * with_payload + 500
                    if held > 4 << 20:
                        yield _batch(rows, arrow)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, arrow)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the columns of its response, revisit or resource record, ``requests`` and ``metadata`` (arrays of records), and ``part``.

    Records belong together when either names the other in WARC-Concurrent-To. Requests and metadata records that no capture
    goes with form a row of null capture columns for each identifier they name (their own where they name none). More than
    ``RECORDS_PER_ROW`` records of one capture are dealt over rows of part 0, 1 and so on; every other capture has part 0 only.
    """
    is_capture = F.col("record_type").isin("response", "revisit", "resource")
    captures, others = records.filter(is_capture), records.filter(~F.coalesce(is_capture, F.lit(False)) & F.coalesce(F.col("record_type") != "warcinfo", F.lit(True)))
    captures = captures.withColumn("capture_id", F.coalesce("record_id", F.concat(F.lit("none:"), F.monotonically_increasing_id())))
    names = captures.select("capture_id", F.explode(F.array_union(F.array("capture_id"), F.coalesce("concurrent_to", F.array().cast("array<string>")))).alias("named")).distinct()
    record = F.struct(*(F.col(c) for c in records.columns)).alias("record")
    own = F.when(F.size("concurrent_to") > 0, F.array_union("concurrent_to", F.array("record_id"))).otherwise(F.array(F.coalesce("record_id", F.lit("none"))))
    linked = others.select(F.monotonically_increasing_id().alias("row"), record, own.alias("own")).select("row", "record", F.posexplode("own").alias("at", "named")).join(names, "named", "left")
    # A record without a capture stays under the first identifier that it names.
    linked = linked.filter("capture_id IS NOT NULL OR at = 0").select("row", "record", F.coalesce("capture_id", "named").alias("capture_id"), F.col("capture_id").isNull().alias("orphan")).dropDuplicates(["row", "capture_id"])
    sizes = linked.groupBy("capture_id").count().filter(F.col("count") > RECORDS_PER_ROW).select("capture_id", F.ceil(F.col("count") / RECORDS_PER_ROW).alias("parts"))
    linked = linked.join(sizes, "capture_id", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("record.record_id", "row"), F.col("parts")), F.lit(0)).cast("int"))
    of = lambda kind, name: F.array_sort(F.collect_list(F.when(kind, F.struct(F.col("record.record_id").alias("id"), "record"))), _by_id).getField("record").alias(name)
    asked = F.col("record.record_type") == "request"
    grouped = linked.groupBy("capture_id", "part").agg(of(asked, "requests"), of(~F.coalesce(asked, F.lit(False)), "metadata"), F.max("orphan").alias("orphan"))
    nothing = [F.coalesce(c, F.array().cast(grouped.schema[c].dataType)).alias(c) for c in ("requests", "metadata")]
    return captures.join(grouped, "capture_id", "full").select(*captures.columns, F.coalesce("part", F.lit(0)).alias("part"), *nothing)


def _by_id(a: Column, b: Column) -> Column:
    x, y = F.coalesce(a["id"], F.lit("")), F.coalesce(b["id"], F.lit(""))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def archived(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as an archive to the shared folder, reads it back and assembles it: page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri, n_requests, n_metadata.

    Null pages ids are responses and never referred to. Rows that repeat a page id and its payload are responses if that id is
    the smallest, else revisits, each with a capture of its own. Payloads under 100 bytes are always responses.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_pages(pages, path)
    # Assembly goes through the records three times; parsed, and without payloads, they are a small part of the archive.
    rows = assemble(materialize(read_records(spark, path, with_payload=False), "warc-records")).filter("part = 0 AND record_type IN ('response', 'revisit')")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"), "target_uri", F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages"))


OP1_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id > first THEN first END AS refers_to, url AS target_uri, 1 AS n_requests, 1 AS n_metadata
FROM f
"""
