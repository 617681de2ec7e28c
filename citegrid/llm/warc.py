"""WARC archives with an index: records are written first, with an index row each (archive, offset,
length, URL, digest); any selection of them is then read back by sorted byte ranges, near ranges joined
into one read.

Every record is a gzip member of its own. Of records with equal payloads of at least ``MIN_REVISIT``
bytes, the one with the largest id is a response and the others revisit it; rows that share the largest
id with an equal payload are all responses. Each task writes its own archive into the shared folder; a
task that runs twice writes two, and the index has the archive of the run that counted.

Nulls: null html is an empty payload; a null url has no target header; a null id is never the largest
and is null again when read. Repeated pages are records of their own. An empty table writes no archive.
Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, ship, table, written

MIN_REVISIT = 1000
ARCHIVE_BYTES = 1 << 30
READ_GAP = 64 << 10
READ_BYTES = 8 << 20
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, archive string, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html with payload_digest, record_type and refers_to."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("payload_digest"))
    groups = written(
        rows.filter(F.octet_length("html") >= MIN_REVISIT)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select("payload_digest", "keeper"),
        "warc-payloads",  # apart from the join, so that Spark can split a payload with many pages there
    )
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return rows.join(groups.hint("shuffle_merge"), "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to")
    )


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, uncompressed."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes every row as a record; gives the index, which is read from a table of the shared folder."""
    ship(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for r in batch.to_pylist():
                    if out is None or offset >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    payload = (r["html"] or "").encode()
                    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    raw = pack.compress(record(r["page_id"], r["url"], payload, r["payload_digest"], r["refers_to"], date)) + pack.flush()
                    out.write(raw)
                    rows.append((r["page_id"], r["url"], name, offset, len(raw), len(payload), r["payload_digest"], r["record_type"], r["refers_to"]))
                    offset += len(raw)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
                names = [c.split()[0] for c in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return written(with_record_types(pages).mapInArrow(write, INDEX), "warc-index")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_records(index: DataFrame, folder: str, where: Column | None = None, with_payload: bool = True) -> DataFrame:
    """The records that an index selects, from their archives. A revisit's payload is null; its size and
    digest are those of the full payload all the same."""
    ship(index.sparkSession)
    chosen = index if where is None else index.filter(where)

    def page(urn: str | None) -> int | None:
        number = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
        return int(number[1]) if number else None

    def ranges(at: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
        run: list[tuple[str, int, int]] = []
        for name, offset, length in sorted(at):
            if run and (name != run[-1][0] or offset - run[-1][1] - run[-1][2] > READ_GAP or offset + length - run[0][1] > READ_BYTES):
                yield run
                run = []
            run.append((name, offset, length))
        if run:
            yield run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for run in ranges(list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))):
                with fs.open_input_file(f"{root}/{run[0][0]}") as f:
                    raw = memoryview(f.read_at(run[-1][1] + run[-1][2] - run[0][1], run[0][1]))
                rows = []
                for _, offset, length in run:
                    fields, block = parse(zlib.decompress(raw[offset - run[0][1] : offset - run[0][1] + length], 31))
                    payload = block.partition(b"\r\n\r\n")[2] if fields["WARC-Type"] == "response" else None
                    size, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if payload is not None:
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        if f"sha1:{digest}" != fields["WARC-Payload-Digest"]:
                            raise ValueError(f"{run[0][0]}, offset {offset}: the payload is damaged")
                    rows.append((page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], page(fields.get("WARC-Refers-To")), payload if with_payload else None))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])

    return chosen.select("archive", "offset", "length").mapInArrow(read, RECORDS)


def op7_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_records(index, folder, with_payload=False).drop("payload")


OP7_SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= {MIN_REVISIT} GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (payload_digest)
"""
