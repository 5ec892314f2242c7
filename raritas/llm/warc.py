"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing: every task writes archives of its own into the shared folder and returns one index row per record (file,
offset, length, url, digest). The index is written as Parquet; a file of a task that was lost or run twice is in no
index row, so it is never read. Records are gzip members of their own, as the format recommends.

Reading: the selected index rows are sorted by (file, offset); neighbouring ranges with a gap of at most ``gap`` bytes
are read at once, up to ``most`` bytes a read.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from raritas.functions.runtime import open_folder, ship_package
from raritas.llm.common import BROADCAST_ROWS, shared_folder

LEAST_BYTES = 1000
ARCHIVE_BYTES = 1 << 30
GAP_BYTES = 1 << 16
READ_BYTES = 8 << 20
DATE = "2020-01-01T00:00:00Z"  # of all records, so that a task run again writes the same bytes


def mark_revisits(pages: DataFrame, key: str, url: str, html: str, least: int = LEAST_BYTES) -> DataFrame:
    """Columns key, url, html, digest (SHA-1 hex), revisit, refers_to (key of the response).

    Of rows with equal payloads of at least ``least`` bytes the one with the largest key is the response (rows that share
    that key are responses all; null keys count as smallest, and a group of null keys alone is all responses).
    Only digests that occur under more than one key are looked up.
    """
    given = pages.select(F.col(key).alias("key"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    marked = given.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    narrow = marked.where(F.col("bytes") >= least).select("key", "digest")
    groups = narrow.groupBy("digest").agg(F.max("key").alias("response"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("response").isNotNull())
    groups = groups.drop("n")
    if groups.count() <= BROADCAST_ROWS:
        joined = marked.join(F.broadcast(groups), "digest", "left")
    else:  # decide on narrow rows first, so that payloads are moved by their keys and never by a common digest
        decided = narrow.join(groups, "digest").where(~F.col("key").eqNullSafe(F.col("response"))).distinct()
        decided = decided.withColumnsRenamed({"key": "d_key", "digest": "d_digest"})
        joined = marked.join(decided, F.col("key").eqNullSafe(F.col("d_key")) & (F.col("digest") == F.col("d_digest")), "left")
    revisit = F.col("response").isNotNull() & ~F.col("key").eqNullSafe(F.col("response")) & (F.col("bytes") >= least)
    return joined.select("key", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("response")).alias("refers_to"))


def record_bytes(key, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One record as a gzip member; a revisit holds the payload's HTTP header only."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    header = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if key is None else key}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        header["WARC-Refers-To"] = f"<urn:page:{refers_to}>"
        header["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    lines = "".join(f"{name}: {value}\r\n" for name, value in header.items())
    return gzip.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n", compresslevel=3, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header, HTTP header and payload of one gzip member."""
    whole = gzip.decompress(raw)
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload



def write_archives(marked: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the rows of ``mark_revisits`` to archives below ``folder``; return the index, itself a table in it."""
    spark = marked.sparkSession
    ship_package(spark)
    schema = marked.select("key").schema
    for field in ("file string", "offset long", "length long", "url string", "digest string"):
        schema = schema.add(*field.split())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_folder(folder)
        store.create_dir(f"{root}/archives", recursive=True)
        out, name, offset = None, None, 0
        try:
            for batch in batches:
                rows = []
                for row in zip(*(batch.column(c) for c in ("key", "url", "html", "digest", "refers_to")), strict=True):
                    key, url, html, digest, refers_to = (v.as_py() for v in row)
                    if out is None or offset >= archive_bytes:
                        if out is not None:
                            out.close()
                        attempt = TaskContext.get().taskAttemptId()
                        name, offset = f"archives/{attempt}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    raw = record_bytes(key, url, html.encode(), digest, refers_to)
                    out.write(raw)
                    rows.append((key, name, offset, len(raw), url, digest))
                    offset += len(raw)
                if rows:
                    columns = list(zip(*rows, strict=True))
                    types = [batch.schema.field("key").type, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=schema.names)
        finally:
            if out is not None:
                out.close()

    marked.mapInArrow(run, schema).write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


def coalesced(rows: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[int]]]:
    """Reads (file, start, end, places of the rows in it) over rows sorted by (file, offset)."""
    start = end = 0
    at, held = None, []
    for place, (file, offset, length) in enumerate(rows):
        if held and (file != at or offset - end > gap or offset < start or offset + length - start > most):
            yield at, start, end, held
            held = []
        if not held:
            at, start, end = file, offset, offset
        held.append(place)
        end = max(end, offset + length)
    if held:
        yield at, start, end, held


def read_archives(index: DataFrame, folder: str, gap: int = GAP_BYTES, most: int = READ_BYTES, payloads: bool = False) -> DataFrame:
    """Records of the given index rows: key, record_type, payload_bytes, payload_digest, refers_to and, if asked, payload.

    Index rows are dealt by ranges of (file, offset), so a large archive is read by many tasks.
    """
    spark = index.sparkSession
    ship_package(spark)
    schema = index.select("key").schema.add("record_type", "string").add("payload_bytes", "long").add("payload_digest", "string").add("refers_to", "string").add("payload", "binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    ordered = index.select("key", "file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        store, root = open_folder(folder)
        opened, name = None, None
        for batch in batches:
            keys = batch.column("key")
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for file, start, end, held in coalesced(rows, gap, most):
                if file != name:
                    opened, name = store.open_input_file(f"{root}/{file}"), file
                raw = opened.read_at(end - start, start)
                out = []
                for i in held:
                    a = rows[i][1] - start
                    fields, http, payload = parse_record(raw[a : a + rows[i][2]])
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest()
                    size = int(http["Content-Length"]) if revisit else len(payload)
                    refers = fields["WARC-Refers-To"].removeprefix("<urn:page:").removesuffix(">") if revisit else None
                    out.append((fields["WARC-Type"], size, digest, refers, payload if payloads and not revisit else None))
                types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                columns = [pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(held)), *columns], names=schema.names)

    read = ordered.mapInArrow(run, schema)
    return read if payloads else read.drop("payload")


def archive_pages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages and read them back: key, payload_bytes, payload_digest, record_type, refers_to.

    A null html is the empty payload, a null url the empty one. An empty table gives an empty index and result.
    """
    index = write_archives(mark_revisits(pages, key, url, html), folder)
    records = read_archives(index, folder)
    kind = pages.schema[key].dataType
    return records.select(
        F.col("key").alias(key), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{folder}/pages.parquet"), shared_folder(spark, "warc"))


SQL = """
WITH given AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
grouped AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS response FROM given)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN response IS NULL OR response = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN response <> page_id THEN response END AS refers_to
FROM grouped
"""
