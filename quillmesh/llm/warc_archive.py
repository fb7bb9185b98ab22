"""WARC archives: an index first, then coalesced byte-range reads of the selected records.

Writing gives one index row (archive, offset, length, URL, digest) for each record; every record is a gzip member of its
own, so that it can be read alone. Reading takes index rows, sorts them by place, joins neighbouring ranges and parses
the records. Equal payloads of ``min_dedup_bytes`` or more are stored once and revisited by the others.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.store import arrow_fs, new_path, written

#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = "urn:page:"
_ESCAPED = re.compile(r"[\x00-\x20\x7f]")


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogatepass")


def record_bytes(page_id, url: str | None, payload: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One record: a response, or a revisit of page ``refers_to`` whose block keeps the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_RECORD}{page_id}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{_RECORD}{refers_to}>"), ("WARC-Profile", PROFILE)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return _header(fields) + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}


def parse_record(raw: bytes) -> dict:
    """Fields of one uncompressed record; raises ``ValueError`` if lengths or the payload's digest don't agree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a WARC record has the wrong length")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(_fields(http)["content-length"])
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (len(payload) != length or hashlib.sha1(payload).digest() != digest):
        raise ValueError("a payload doesn't agree with its digest")
    page = lambda key: fields[key].strip("<>").removeprefix(_RECORD)
    return {
        "page_id": page("warc-record-id"),
        "record_type": fields["warc-type"],
        "payload": None if revisit else payload,
        "payload_bytes": length,
        "payload_digest": digest.hex(),
        "refers_to": page("warc-refers-to") if revisit else None,
    }


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_dedup_bytes: int = 1000, archive_bytes: int = 1 << 30) -> DataFrame:
    """Write every row as a record to archives in the shared folder and return their index, a written table.

    Index: ``page_id string, url, archive, offset, length, payload_digest``. A null body is an empty payload; a null URL
    leaves out the field; a null id is written as ``None``. Of equal payloads, rows with the largest id are responses
    (all of them, if that id repeats). An attempt of a task writes files of names of its own, so one that is lost or run
    twice leaves files that no index row mentions. Digests are pre-aggregated; the join by digest is one that the
    planner can split at a hot payload.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    store, path = arrow_fs(folder)
    store.create_dir(path, recursive=True)
    body = F.coalesce(F.col(body_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body")).withColumn("digest", F.sha1(F.col("body").cast("binary")))
    kept = rows.where(F.octet_length("body") >= min_dedup_bytes).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n")
    refers = F.when(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept")).cast("string")
    planned = rows.join(kept, "digest", "left").select(F.col("page_id").cast("string").alias("page_id"), "url", "body", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = arrow_fs(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index = []
                for page_id, url, body, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= archive_bytes:
                        if out is not None:
                            out.close()
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    payload = body.encode("utf-8", "surrogatepass")
                    packed = gzip.compress(record_bytes(page_id, url, payload, refers_to), 6, mtime=0)
                    out.write(packed)
                    index.append((page_id, url, f"{folder}/{name}", at, len(packed), hashlib.sha1(payload).hexdigest()))
                    at += len(packed)
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                columns = zip(*index, strict=True) if index else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["page_id", "url", "archive", "offset", "length", "payload_digest"])
        finally:
            if out is not None:
                out.close()

    return written(planned.mapInArrow(run, "page_id string, url string, archive string, offset long, length long, payload_digest string"), "warc-index")


def coalesced(places: list[tuple[str, int, int]], gap: int, most: int) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) joined to reads (archive, offset, length, places inside) of up to ``most`` bytes."""
    archive, start, end, inside = "", 0, 0, []
    for name, offset, length in places:
        if inside and (name != archive or offset - end > gap or offset + length - start > most):
            yield archive, start, end - start, inside
            inside = []
        if not inside:
            archive, start = name, offset
        end = max(end, offset + length) if inside else offset + length
        inside.append((offset, length))
    if inside:
        yield archive, start, end - start, inside


def read_records(index: DataFrame, *, gap: int = 64 << 10, most: int = 8 << 20, payloads: bool = True) -> DataFrame:
    """The records of the index rows: ``page_id string, record_type, payload, payload_bytes, payload_digest, refers_to``.

    ``index`` is all or any selection of the rows of :func:`write_archives`; an empty one gives no rows. Rows are dealt
    by archive and offset, so no task gets more than a stretch of an archive. Raises on damaged records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = {}
        names = ["page_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for archive, offset, length, inside in coalesced(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), gap, most):
                folder = archive.rsplit("/", 1)[0]
                if folder not in files:
                    files[folder] = arrow_fs(folder)
                store, base = files[folder]
                with store.open_input_file(f"{base}/{archive.rsplit('/', 1)[1]}") as source:
                    data = source.read_at(length, offset)
                rows = [parse_record(zlib.decompress(data[at - offset : at - offset + n], 31)) for at, n in inside]
                if not payloads:
                    for row in rows:
                        row["payload"] = None
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds, strict=True)], names)

    dealt = index.select("archive", "offset", "length").repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "page_id string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string")


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with the payload of every revisit filled in from the response that it refers to."""
    stored = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("of_")).agg(F.first("payload").alias("stored_"))
    joined = records.join(stored, F.col("refers_to") == F.col("of_"), "left")
    return joined.withColumn("payload", F.coalesce("payload", "stored_")).drop("of_", "stored_")


def digests(records: DataFrame, id_type: str) -> DataFrame:
    """The columns of the records without the payloads, ids in their own type."""
    own = lambda c: F.when(F.col(c) != "None", F.col(c)).cast(id_type)
    return records.select(own("page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", own("refers_to").alias("refers_to"))


#: The same in DuckDB, from the pages alone.
SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND kept IS DISTINCT FROM page_id AND kept IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND kept IS DISTINCT FROM page_id THEN kept END AS refers_to
FROM m
"""
