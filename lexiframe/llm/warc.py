"""WARC archives: write with an index, read selected records by coalesced byte ranges.

Every task writes its pages as one WARC 1.1 file of separately compressed records and reports an index row per record
(file, offset, length, URL, digest).  Files carry a name of their own per task attempt and only those of finished
tasks are in the index.  Reading sorts the selected index rows by file and offset, merges neighbouring ranges and
parses the records out of each range.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, open_filesystem, text_of, written

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records are dated alike: the tables have no crawl time.
DATE = "1970-01-01T00:00:00Z"

#: Bytes of a read range, and of the gap between records that is still read through.
RANGE_BYTES = 4 << 20
GAP_BYTES = 64 << 10
#: Compressed bytes that one reading task is given.
TASK_BYTES = 16 << 20
INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_uri(page_id) -> str:
    return "urn:page:" + ("none" if page_id is None else str(page_id))


def _page_of(uri: str):
    page = uri.rsplit(":", 1)[1]
    return None if page == "none" else int(page)


def _header_text(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def build_record(page_id, url: str | None, payload: bytes, refers_to) -> tuple[bytes, str, str]:
    """(record, digest, type); a revisit has the HTTP headers of its response and no payload."""
    digest = payload_digest(payload)
    kind = "response" if refers_to is None else "revisit"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
            ).encode()
    block = http + payload if kind == "response" else http
    lines = [VERSION.decode(), f"WARC-Type: {kind}", f"WARC-Record-ID: <{_record_uri(page_id)}>",
             f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{_record_uri(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest, kind


def parse_record(record: bytes) -> dict:
    """page_id, url, payload (None for a revisit), payload_bytes, payload_digest, record_type, refers_to."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION:
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.decode().partition(":") for line in lines)}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
    out = {"page_id": _page_of(fields["warc-record-id"].strip("<>")), "url": fields.get("warc-target-uri"),
           "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest,
           "record_type": kind, "refers_to": _page_of(fields["warc-refers-to"].strip("<>")) if kind == "revisit" else None}
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"damaged record of page {out['page_id']}")
    return out


def with_references(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to: the page that a revisit refers to, null for a response.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest id is the response.  Only
    digests that occur more than once go into the join; rows that repeat the largest id are responses as well, and
    null ids are smaller than all others (a payload known only under null ids is all responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        text_of("html").alias("html"))
    sha = F.sha1(F.encode("html", "utf-8"))
    counted = rows.where(F.octet_length("html") >= min_bytes).groupBy(sha.alias("sha")).agg(
        F.count(F.lit(1)).alias("n"), F.max("page_id").alias("target"))
    # a table of its own, so that the join can split the pages of a payload that is everywhere
    repeated = written(counted.where("n > 1").select("sha", "target"), "repeated-payloads")
    joined = rows.withColumn("sha", sha).join(repeated, "sha", "left")
    revisit = F.col("target").isNotNull() & ~F.col("target").eqNullSafe(F.col("page_id"))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("target")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes .warc.gz files below ``folder`` and returns the index (columns ``INDEX``), one row per page.

    A null html is an empty payload, a null url leaves its header out; an empty table writes nothing."""
    def write(batches):
        stream = None
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if stream is None:
                    fs, root = open_filesystem(folder)
                    fs.create_dir(root, recursive=True)
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    stream = fs.open_output_stream(f"{root}/{name}", compression=None)
                record, digest, kind = build_record(page_id, url, html.encode(), refers_to)
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record) + packer.flush()
                stream.write(data)
                rows.append((f"{folder}/{name}", at, len(data), page_id, url, digest, kind))
                at += len(data)
            if rows:
                yield _batch(rows, ("file", "offset", "length", "page_id", "url", "digest", "record_type"), (3, 1, 1, 1, 3, 3, 3))
        if stream is not None:
            stream.close()
    return with_references(pages, min_bytes).mapInArrow(write, INDEX)


def _batch(rows, names, kinds):
    types = {1: pa.int64(), 2: pa.binary(), 3: pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds)], list(names))


def coalesce_ranges(spans: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = RANGE_BYTES) -> list[tuple[int, int, list]]:
    """(start, end, spans) of sorted (offset, length) spans: neighbours at most ``gap`` bytes apart share a range of
    at most ``most`` bytes (a single longer record is a range of its own)."""
    out = []
    for offset, length in spans:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= most:
            out[-1][1] = max(out[-1][1], offset + length)
            out[-1][2].append((offset, length))
        else:
            out.append([offset, offset + length, [(offset, length)]])
    return [tuple(x) for x in out]


def read_records(selected: DataFrame, payload: bool = True) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of the records that the rows of
    ``selected`` (columns of the index) point to.

    Rows are dealt by file and range of ``RANGE_BYTES`` and read in offset order; every response is checked against
    its digest.  ``payload=False`` leaves the payload column null."""
    def read(batches):
        held, open_file, stream = [], None, None

        def fetch():
            nonlocal open_file, stream
            for lo, hi, spans in coalesce_ranges([(o, n) for _, o, n in held]):
                if open_file != held[0][0]:
                    if stream is not None:
                        stream.close()
                    fs, name = open_filesystem(held[0][0])
                    open_file, stream = held[0][0], fs.open_input_file(name)
                stream.seek(lo)
                data = stream.read(hi - lo)
                rows = []
                for o, n in spans:
                    r = parse_record(zlib.decompress(data[o - lo:o - lo + n], 31))
                    rows.append((r["page_id"], r["url"], r["payload"] if payload else None, r["payload_bytes"],
                                 r["payload_digest"], r["record_type"], r["refers_to"]))
                yield _batch(rows, ("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type",
                                    "refers_to"), (1, 3, 2, 1, 3, 3, 1))

        for batch in batches:
            for span in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (span[0] != held[0][0] or span[1] + span[2] - held[0][1] > RANGE_BYTES):
                    yield from fetch()
                    held = []
                held.append(span)
        if held:
            yield from fetch()
        if stream is not None:
            stream.close()

    ranged = selected.select("file", "offset", "length", F.floor(F.col("offset") / RANGE_BYTES).alias("part"))
    # by the bytes to read: the index rows themselves are too small to tell Spark about the work
    tasks = (selected.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES + 1
    return ranged.repartition(tasks, "file", "part").sortWithinPartitions("file", "offset").select("file", "offset", "length") \
        .mapInArrow(read, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
                          "record_type string, refers_to long")


def archive_report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and returns what reading them back gives per page."""
    index = written(write_warc(pages, new_folder(pages.sparkSession, "warc"), min_bytes), "warc-index")
    return read_records(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type",
                                                     "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
b AS (SELECT page_id, h, s, array_to_string(list_transform(range(40), lambda i:
        CASE substr(s, CAST(i + 1 AS INT), 1) WHEN '0' THEN '0000' WHEN '1' THEN '0001' WHEN '2' THEN '0010'
        WHEN '3' THEN '0011' WHEN '4' THEN '0100' WHEN '5' THEN '0101' WHEN '6' THEN '0110' WHEN '7' THEN '0111'
        WHEN '8' THEN '1000' WHEN '9' THEN '1001' WHEN 'a' THEN '1010' WHEN 'b' THEN '1011' WHEN 'c' THEN '1100'
        WHEN 'd' THEN '1101' WHEN 'e' THEN '1110' ELSE '1111' END), '') AS bits,
        max(page_id) OVER (PARTITION BY s) AS last_page FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
         16 * CAST(substr(bits, CAST(5 * i + 1 AS INT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS INT), 1) AS INT)
         + 4 * CAST(substr(bits, CAST(5 * i + 3 AS INT), 1) AS INT) + 2 * CAST(substr(bits, CAST(5 * i + 4 AS INT), 1) AS INT)
         + CAST(substr(bits, CAST(5 * i + 5 AS INT), 1) AS INT) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = last_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = last_page THEN NULL ELSE last_page END AS refers_to
FROM b
"""
