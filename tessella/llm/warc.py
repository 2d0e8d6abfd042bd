"""WARC archives: one gzip member per record, written and read on Spark.

An archive is one row (archive, data) of bounded size, kept as a table in the shared scratch
folder; ``read_warc_files`` reads archives that are files (``*.warc.gz``) the same way. The reader
is sequential: it inflates member after member piece by piece, splits header and block by the
header's Content-Length, and checks the block and payload digests.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.shared import arrow_map, keep, table, text_of

ARCHIVE_BYTES = 16 << 20
REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
#: Fixed value of the WARC 1.1 format for revisits of an equal payload.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, record_type string, target_uri string, refers_to long, payload_bytes long, payload_digest string, payload binary, valid boolean"


def _sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _uri(url: str | None, page_id: int | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"


def _member(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", _sha1(block)), ("Content-Length", len(block))]) + "\r\n"
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One gzip member with a response record, or with a revisit record if ``refers_to`` is given:
    that has the HTTP header and the full payload's digest, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    name = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(i))}>"
    fields: list[tuple[str, object]] = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", _uri(url, page_id)), ("WARC-Payload-Digest", _sha1(payload)), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("Page-ID", page_id))
    if refers_to is not None:
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", name(refers_to)), ("Refers-To-Page-ID", refers_to)]
    return _member(fields, http if refers_to is not None else http + payload)


def members(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """The inflated content of each gzip member of a stream that arrives in chunks; ValueError if it
    ends inside a member, wherever that is."""
    inflate, parts, begun = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            parts.append(inflate.decompress(chunk))
            chunk, begun = b"", True
            if inflate.eof:
                yield b"".join(parts)
                chunk, inflate, parts, begun = inflate.unused_data, zlib.decompressobj(31), [], False
    if begun:
        raise ValueError("the archive ends inside a gzip member")


def sha1_hex(stated: str | None) -> str | None:
    """The hex SHA-1 of a digest field in base 32 or hex; None for another algorithm, or none."""
    kind, _, value = (stated or "").partition(":")
    if kind.strip().lower() != "sha1":
        return None
    value = value.strip()
    if re.fullmatch(r"[0-9A-Fa-f]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


def records(chunks: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(header fields with lower-case names, block, whether framing and block digest hold)."""
    for raw in members(chunks):
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(n) if re.fullmatch(r"\d+", n := fields.get("content-length", "")) else -1
        block = rest[: max(0, size)]
        framed = lines[0].startswith("WARC/") and len(block) == size and rest[size:] == b"\r\n\r\n"
        stated = sha1_hex(fields.get("warc-block-digest"))
        yield fields, block, framed and stated in (None, hashlib.sha1(block).hexdigest())


def _parsed(chunks: Iterable[bytes]) -> Iterator[tuple]:
    number = lambda s: None if s is None else int(s)
    for fields, block, valid in records(chunks):
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = sha1_hex(fields.get("warc-payload-digest"))
        stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size = len(payload) if kind == "response" else int(stated[1]) if stated else None
        if kind == "response":
            own = hashlib.sha1(payload).hexdigest()
            valid, digest = valid and digest in (None, own), own
        yield number(fields.get("page-id")), kind, fields.get("warc-target-uri"), number(fields.get("refers-to-page-id")), size, digest, payload if kind == "response" else None, valid


def _read(batch: pa.RecordBatch) -> Iterator[dict]:
    columns = [c.split()[0] for c in RECORD.split(", ")]
    for data in batch["data"].to_pylist():
        rows, size = [], 0
        for row in _parsed(data[i : i + 65536] for i in range(0, len(data), 65536)):
            rows.append(row)
            size += len(row[6] or b"")
            if size > ARCHIVE_BYTES:
                yield dict(zip(columns, map(list, zip(*rows))))
                rows, size = [], 0
        if rows:
            yield dict(zip(columns, map(list, zip(*rows))))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [_info()], 0
    archive = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["data"])
    for batch in batches:
        for page_id, url, payload, refers_to in zip(*(batch[c] for c in ("page_id", "url", "payload", "refers_to"))):
            parts.append(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield archive()
                parts, size = [_info()], 0
    if len(parts) > 1:
        yield archive()


def _info() -> bytes:
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, 'warcinfo')}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def write_warc(pages: DataFrame) -> DataFrame:
    """Archives (data binary), a row each, of all rows (page_id, url, html) of ``pages``.

    Null html is an empty payload. Of records with equal payloads of ``REVISIT_BYTES`` or more,
    those with the largest page_id are responses (two rows with one id both are) and the others
    revisit it. A null page_id never is the largest; if all of a group are null, all are
    responses. A null url becomes urn:page:ID. Other columns are ignored; no rows, no archives.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(text_of("html"), "UTF-8").alias("payload")).withColumn("same", F.sha2("payload", 256))
    latest = own.filter(F.length("payload") >= REVISIT_BYTES).groupBy("same").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("same").alias("latest_same"), "latest")
    latest = keep(latest, "latest")  # a table, so that Spark can split the join at a payload with many copies
    revisits = own.join(latest, F.col("same") == F.col("latest_same"), "left").withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")))
    return revisits.select("page_id", "url", "payload", "refers_to").mapInArrow(_write, "data binary")


def read_warc(archives: DataFrame, data_col: str = "data") -> DataFrame:
    """Response and revisit records of archives held as rows; see ``RECORD`` for the columns."""
    return arrow_map(archives.select(F.col(data_col).alias("data")), _read, RECORD)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """The same of files; each file is read whole by one task, so files of ordinary WARC size."""
    return read_warc(spark.read.format("binaryFile").load(path).select("content"), "content")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives, reads them back; per page page_id, payload_bytes, payload_digest,
    record_type, refers_to. A record that fails its framing or digests is an error."""
    found = read_warc(keep(write_warc(pages), "warc"))
    return found.select("page_id", "payload_bytes", "payload_digest", F.when(F.col("valid"), F.col("record_type")).otherwise(F.raise_error(F.lit("a record fails its digests"))).alias("record_type"), "refers_to")


def op6_query(spark, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS latest FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> latest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> latest THEN latest END AS refers_to
FROM g
"""
