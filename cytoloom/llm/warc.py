r"""WARC archives with revisit resolution.

Payloads are hashed where they are; only their headers (page, uri, digest, length) are shuffled, by digest, and the record
with the least page_id of each digest becomes the original response. Headers of the others are joined to it and become
revisit records. Then the archives are written with fresh headers: responses with their payload, revisits without,
both dated by the run, revisits with the record, uri and date of their response.

Archives are written by Spark's text sink, one record a row and \r\n\r\n, which ends every WARC record, between them.
So they go to any store that Spark writes to, under its commit protocol: a task that dies or runs twice leaves no
second copy. A task starts a new archive whenever the bytes of the last would pass FILE_BYTES; only a single record may
be larger than that. Payload-bearing rows are not shuffled unless there are more than MAX_BROADCAST revisits.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, map_arrow, materialize, new_path

MAX_BROADCAST = 100_000
FILE_BYTES = 24 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_LENGTH = re.compile(rb"^Content-Length:\s*(\d+)\s*$", re.I | re.M)
_FIELD = re.compile(rb"^([\w-]+):[ \t]*(.*?)\r?$", re.M)
_LINES = re.compile(r"[\r\n]+")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _rows(pages: DataFrame) -> DataFrame:
    """page_id, url, html (null: empty) and sha, the payload's SHA-1 in hex."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.withColumn("sha", F.sha1("html"))


def payload_headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, sha, payload_bytes) of each row."""
    return _rows(pages).select("page_id", "url", "sha", F.octet_length("html").cast("long").alias("payload_bytes"))


def resolve(headers: DataFrame, least_bytes: int = 0) -> DataFrame:
    """headers with refers_to and refers_uri: the least page_id with the same payload and its url, null for that record
    itself, for payloads below least_bytes, and where no record of the payload has a page_id."""
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    same = headers.filter(F.col("payload_bytes") >= least_bytes).groupBy("sha", "payload_bytes").agg(first, F.count("*").alias("n"))
    same = materialize(same.filter("n > 1"), "warc-originals")
    found = lookup(headers, same, ["sha", "payload_bytes"], "n")
    other = ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return found.select("page_id", "url", "sha", "payload_bytes", F.when(other, F.col("first.page_id")).alias("refers_to"), F.when(other, F.col("first.url")).alias("refers_uri"))


def _uri(url: str | None) -> str:
    return "about:blank" if url is None else _LINES.sub("%0A", url)


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: str, digest: str, refers_to: int | None, refers_uri: str | None, date: str) -> str:
    """One record, without the two line ends after it: a response, or where refers_to is given a revisit of it."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload.encode())}\r\n\r\n"
    block = head + payload if refers_to is None else head
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Refers-To-Target-URI: {_uri(refers_uri)}", f"WARC-Refers-To-Date: {date}"]
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block.encode())}"]
    return "\r\n".join(fields) + "\r\n\r\n" + block


def write_archives(pages: DataFrame, path: str, *, least_bytes: int = 0, date: str | None = None, compression: str = "none", file_bytes: int = FILE_BYTES) -> str:
    """Write deduplicated archives of pages (page_id, url, html) under path. date is that of all records, by default the
    time of the run; compression is none or gzip (of whole archives, so records aren't reached one by one then).

    A null html is an empty payload, a null url is about:blank, a null page_id is written as none. Rows that repeat a
    page_id and payload are the same record and share its type. An empty table gives no archive."""
    when = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    headers = materialize(payload_headers(pages), "warc-headers")
    found = materialize(resolve(headers, least_bytes), "warc-resolved")
    own = F.coalesce(F.col("page_id").cast("string"), F.lit("none")).alias("own")
    revisits = found.filter("refers_to IS NOT NULL").groupBy(own, "sha").agg(F.min("refers_to").alias("refers_to"), F.min("refers_uri").alias("refers_uri"), F.count("*").alias("n"))
    revisits = materialize(revisits, "warc-revisits")
    rows = _rows(pages).select("*", own)
    few = revisits.count() <= MAX_BROADCAST
    rows = rows.join(F.broadcast(revisits.drop("n")), ["own", "sha"], "left") if few else lookup(rows, revisits, ["own", "sha"], "n")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for page_id, url, html, sha, refers_to, refers_uri in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    text = record(page_id, url, html, digest, refers_to, refers_uri, when)
                    size = len(text.encode()) + 4
                    if held and held + size > file_bytes:
                        number, held = number + 1, 0
                    held += size
                    out.append((text, number))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32())], names=["value", "archive"])

    records = map_arrow(rows.select("page_id", "url", "html", "sha", "refers_to", "refers_uri"), work, "value string, archive int")
    records.write.mode("overwrite").partitionBy("archive").option("lineSep", "\r\n\r\n").option("compression", compression).text(path)
    return path


def parse_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive, read by its lengths; gzip is undone first."""
    if data[:2] == b"\x1f\x8b":
        import gzip

        data = gzip.decompress(data)
    view, at = memoryview(data), 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(data[at:end])}
        start = end + 4
        stop = start + int(fields["content-length"])
        if stop > len(data):
            raise ValueError(f"the record at byte {at} is cut off")
        yield fields, bytes(view[start:stop])
        at = stop + 4


def _page(uri: str) -> int | None:
    name = uri.removeprefix("<urn:x-page:").removesuffix(">")
    return None if name == "none" else int(name)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            rows = []
            for fields, block in parse_archive(batch.column(0)[i].as_py()):
                head, _, payload = block.partition(b"\r\n\r\n")
                size, digest, kind = int(_LENGTH.search(head)[1]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
                    raise ValueError(f"{fields['warc-record-id']} does not match its digest")
                refers = (_page(fields["warc-refers-to"]), fields["warc-refers-to-target-uri"], fields["warc-refers-to-date"]) if kind == "revisit" else (None, None, None)
                rows.append((_page(fields["warc-record-id"]), fields.get("warc-target-uri"), fields.get("warc-date"), size, digest, kind, *refers, payload.decode() if kind == "response" else None))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            names = ["page_id", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to", "refers_uri", "refers_date", "payload"]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)


def read_archives(spark, path: str) -> DataFrame:
    """Every record under path: page_id, url, date, payload_bytes, payload_digest, record_type, refers_to, refers_uri,
    refers_date, payload (null in revisits). Lengths and digests of responses are checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return map_arrow(files, _read, "page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_uri string, refers_date string, payload string")


def archived_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, read them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Cases as in write_archives."""
    spark = pages.sparkSession
    path = write_archives(pages, new_path(spark, "warc"), least_bytes=least_bytes)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
