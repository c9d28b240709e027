"""WARC archives: a writer of request, response, revisit and metadata records, and transaction assembly on reading.

Writing: of pages with equal payloads of at least ``REVISIT_BYTES`` bytes, the one with the smallest page_id becomes the
response and the others become revisits that refer to it (WARC-Refers-To) and carry no payload. Each page gives three records
(request, response or revisit, metadata), tied together by WARC-Concurrent-To. Every record is a gzip member of its own, and
an archive begins with a warcinfo record. Spark's text sink writes the members, so commits and retries are Spark's own: it
ends each row with a NUL, which is the last byte of any gzip member of less than 16 MB (a longer one is followed by an empty
member). A task begins a new archive after ``ARCHIVE_BYTES``, however long pages are.

Reading: archives are read record by record, cut by Content-Length (never by a search for separators, which payloads may
contain). Records are joined through their concurrent-to identifiers, whichever of the two records names the other, and each
capture becomes one nested row; of several requests of one capture that of the smallest identifier is taken. Records that
name no capture found are kept apart by ``dangling``.

Null html is an empty payload; null page_id or url leaves out its header and reads back as null. Rows that repeat both a
page_id and its html are captures of their own, and all those with the smallest page_id are responses. Line breaks in a
url are percent-encoded. An empty table gives no captures. Extra columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cascata.llm.common import bounded_batches, with_row_key
from cascata.session import scratch, visible_to_workers

REVISIT_BYTES = 100
ARCHIVE_BYTES = 32 << 20
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes, record_type, refers_to and the identifiers of the records of each page."""
    keyed, keys = with_row_key(pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html")))
    row = F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("row")
    rows = keyed.select("page_id", "url", "html", row).withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    large = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).select("page_id", "payload_digest", "row")
    least = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row"))
    first = large.groupBy(F.col("payload_digest").alias("_digest")).agg(least.alias("_first"), F.count("*").alias("_n")).where("_n > 1 and not _first.none")
    joined = rows.join(first, (F.col("payload_digest") == F.col("_digest")) & (F.col("payload_bytes") >= REVISIT_BYTES), "left")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    ids = [_urn(kind, F.col("page_id"), F.col("row")).alias(name) for kind, name in (("response", "response_id"), ("request", "request_id"), ("metadata", "metadata_id"))]
    refers = [F.when(again, F.col("_first.page_id")).alias("refers_to"), F.when(again, _urn("response", F.col("_first.page_id"), F.col("_first.row"))).alias("refers_to_id")]
    return joined.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), *refers, *ids)


def _urn(kind: str, page_id: Column, row: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), F.coalesce(page_id.cast("string"), F.lit("-")), row))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column, headers: list[Column], block: Column) -> Column:
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), *headers, F.concat(F.lit("WARC-Block-Digest: sha256:"), F.sha2(block.cast("binary"), 256)), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block, F.lit(END))


def member(record: bytes) -> bytes:
    """``record`` as a gzip member that ends with a NUL, as one of less than 16 MB does by itself."""
    packed = gzip.compress(record, 1, mtime=0)
    return packed if packed[-1] == 0 else packed + gzip.compress(b"", mtime=0)


def _archives(archive_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(archive, member) of the records of a task; the sink puts back the NUL that each member ends with."""
        schema = pa.schema([("archive", pa.int32()), ("member", pa.binary())])
        archive, size = -1, archive_bytes
        for batch in batches:
            places, members = [], []
            for row in zip(*(batch.column(c) for c in ("request", "response", "metadata"))):
                if size >= archive_bytes:
                    archive, size = archive + 1, 0
                    block = b"software: cascata\r\nformat: WARC File Format 1.1\r\n"
                    info = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}{END}"
                    places.append(archive)
                    members.append(member(info.encode() + block + END.encode())[:-1])
                for record in row:
                    packed = member(record.as_buffer())
                    places.append(archive)
                    members.append(packed[:-1])
                    size += len(packed)
            yield pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array(members, pa.binary())], schema=schema)

    return pack


def write(pages: DataFrame, path: str) -> None:
    """Write gzip-compressed archives of ``pages`` (page_id, url, html) below ``path``."""
    bounded_batches(pages.sparkSession)
    visible_to_workers(pages.sparkSession)
    rows = plan_records(pages)
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    path_of = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("/")), "^[A-Za-z]+://[^/?#]*", ""), "#.*$", "")
    common = [F.concat(F.lit("WARC-Target-URI: "), url), F.lit(f"WARC-Date: {DATE}"), F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"))]
    said = [F.concat(F.lit("WARC-Record-ID: "), F.col("response_id")), F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest")), F.lit("Content-Type: application/http; msgtype=response")]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    again = F.col("record_type") == "revisit"
    profile = [F.when(again, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), F.concat(F.lit("WARC-Refers-To: "), F.col("refers_to_id")), F.concat(F.lit("X-Refers-To-Page-Id: "), F.col("refers_to").cast("string"))]
    of = F.concat(F.lit("WARC-Concurrent-To: "), F.col("response_id"))
    request = _record(F.lit("request"), [F.concat(F.lit("WARC-Record-ID: "), F.col("request_id")), of, *common, F.lit("Content-Type: application/http; msgtype=request")], F.concat(F.lit("GET "), path_of, F.lit(" HTTP/1.1"), F.lit(END)))
    response = _record(F.col("record_type"), [*said, *common, *profile], F.concat(http, F.when(again, "").otherwise(F.col("html"))))
    metadata = _record(F.lit("metadata"), [F.concat(F.lit("WARC-Record-ID: "), F.col("metadata_id")), of, *common, F.lit("Content-Type: application/warc-fields")], F.lit("fetchTimeMs: 0\r\nvia: crawl\r\n"))
    packed = rows.select(*[r.cast("binary").alias(n) for r, n in ((request, "request"), (response, "response"), (metadata, "metadata"))]).mapInArrow(_archives(ARCHIVE_BYTES), "archive int, member binary")
    packed.select("archive", F.col("member").cast("string").alias("value")).write.partitionBy("archive").option("lineSep", "\u0000").text(path)


def parse(data: bytes | io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an uncompressed archive, one record at a time."""
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    n = 0
    while True:
        line = stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        if not re.fullmatch(rb"WARC/1\.[01]\r\n", line):
            raise ValueError(f"no WARC record after record {n}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError(f"record {n + 1} is cut short")
        yield headers, block
        n += 1


RECORD = pa.schema([("record_id", pa.string()), ("kind", pa.string()), ("concurrent_to", pa.string()), ("url", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("block", pa.binary())])
RECORD_SQL = "record_id string, kind string, concurrent_to string, url string, page_id long, refers_to long, digest string, payload_bytes long, block binary"


def _number(x: str | None) -> int | None:
    return None if x is None else int(x)


def _reader(with_blocks: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                data = content.as_py()
                rows, size = [], 0
                for h, block in parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(data))) if data[:2] == b"\x1f\x8b" else data):
                    kind, payload_bytes, digest = h["warc-type"], None, None
                    if kind in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        declared = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                        digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
                        if kind == "response":
                            payload_bytes = len(payload)
                            if digest != hashlib.sha256(payload).hexdigest():
                                raise ValueError(f"payload of {h['warc-record-id']} differs from its digest")
                        else:
                            payload_bytes = int(declared[1])
                    rows.append((h["warc-record-id"], kind, h.get("warc-concurrent-to"), h.get("warc-target-uri"), _number(h.get("x-page-id")), _number(h.get("x-refers-to-page-id")), digest, payload_bytes, block if with_blocks else None))
                    size += len(block) if with_blocks else 0
                    if len(rows) >= 10_000 or size >= 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RECORD.types)], schema=RECORD)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), RECORD.types)], schema=RECORD)

    return read


def records(spark: SparkSession, path: str, with_blocks: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``; a task holds one packed archive and one record at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_reader(with_blocks), RECORD_SQL)


def _links(found: DataFrame) -> DataFrame:
    """(capture, other): which record belongs to which response or revisit, whichever of the two names the other."""
    capture = F.col("kind").isin("response", "revisit")
    named = found.where(F.col("concurrent_to").isNotNull() & F.col("kind").isin("response", "revisit", "request", "metadata"))
    ends = F.when(capture, F.struct(F.col("record_id").alias("capture"), F.col("concurrent_to").alias("other"))).otherwise(F.struct(F.col("concurrent_to").alias("capture"), F.col("record_id").alias("other")))
    return named.select(ends.alias("e")).select("e.capture", "e.other")


def assemble(found: DataFrame) -> DataFrame:
    """Transactions: each response or revisit with the request and the metadata record tied to it, as one nested row."""
    nested = F.struct(*[F.col(c) for c in found.columns])
    out = found.where(F.col("kind").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), nested.alias("response"))
    links = _links(found)
    for kind in ("request", "metadata"):
        mine = found.where(F.col("kind") == kind).select(F.col("record_id").alias("other"), nested.alias(kind))
        tied = links.join(mine, "other").groupBy("capture").agg(F.min_by(kind, "other").alias(kind))
        out = out.join(tied, F.col("capture_id") == F.col("capture"), "left").drop("capture")
    return out


def dangling(found: DataFrame) -> DataFrame:
    """Request and metadata records that are tied to no response or revisit among ``found``."""
    captures = found.where(F.col("kind").isin("response", "revisit")).select(F.col("record_id").alias("capture"))
    tied = _links(found).join(captures, "capture", "left_semi").select(F.col("other").alias("record_id"))
    return found.where(F.col("kind").isin("request", "metadata")).join(tied, "record_id", "left_anti")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read them back, and describe each capture."""
    spark = pages.sparkSession
    path = f"{scratch(spark)}/cascata/warc-{uuid.uuid4().hex}"
    write(pages, path)
    captures = assemble(records(spark, path, with_blocks=False))
    r = "response."
    return captures.select(F.col(r + "page_id").alias("page_id"), F.col(r + "payload_bytes").alias("payload_bytes"), F.col(r + "digest").alias("payload_digest"), F.col(r + "kind").alias("record_type"), F.col(r + "refers_to").alias("refers_to"), F.col(r + "url").alias("url"), F.col("request").isNotNull().alias("has_request"), F.col("metadata").isNotNull().alias("has_metadata"))
