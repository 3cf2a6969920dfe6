"""WARC archives with revisit records.

1. Headers only (page id, payload length and digest) are shuffled by payload digest; of equal
   payloads of MIN_BYTES and more the smallest page id is the response, the others revisit it. Up to
   BROADCAST_ROWS repeated digests are looked up where the pages are read. With more, revisit records
   are made from headers alone, and the other pages are told by page id, which has no hot value.
2. Records are written with fresh headers, each as a gzip member of its own; a revisit has no block and
   names the response's record and digest. Each task joins members up to FILE_BYTES (or one longer
   record), and each such value is a file of Spark's text writer, whose commit protocol covers lost
   executors. Its line separator, which ends every file, is an empty gzip member.
3. Archives are read as binary files and decompressed member by member, so that a task holds one file
   and one record; payload digests are computed again and compared. Revisit records are joined to the
   original responses by digest, from which they get the length of the payload.

A null html is an empty payload; a null url gives a record without target. A payload under MIN_BYTES
is always a response. Of equal payloads without any page_id all are responses; rows that repeat the
response's page_id and payload are responses too. A null page_id is written as an empty record id and
read as null. Repeated rows are written each. Further columns are ignored. No pages give no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, BROADCAST_ROWS, discard, join_spooled, pick, shared_dir, spool

MIN_BYTES = 100
#: Compressed bytes of one archive file, unless a record alone is longer.
FILE_BYTES = 32 << 20
#: Payloads of originals are broadcast up to so many bytes.
BROADCAST_BYTES = 64 << 20
#: Bytes that are decompressed at once.
PIECE_BYTES = 1 << 13
EPOCH = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"
EMPTY_MEMBER = gzip.compress(b"", mtime=0)


def resolve(pages: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """page_id, url, payload, bytes, digest, refers_to (null for responses; revisits may lack a payload)."""
    rows = pick(pages, page_id="bigint", url="string", html="string").select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha2("payload", 256)})
    heads = rows.where(F.col("bytes") >= MIN_BYTES).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    several = spool(heads.where("n > 1 and first_id is not null").select("digest", "first_id"), "op2-repeated")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")
    columns = ["page_id", "url", "payload", "bytes", "digest"]
    if several.count() <= broadcast_rows:
        return rows.join(F.broadcast(several), "digest", "left").select(*columns, refers)
    revisits = spool(rows.drop("payload").join(several, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("page_id", "url", "bytes", "digest", refers), "op2-revisits")
    known = revisits.select(F.col("page_id").alias("known_id"), F.col("digest").alias("known_digest")).distinct()
    responses = rows.join(known, [F.col("page_id").eqNullSafe(F.col("known_id")), F.col("digest") == F.col("known_digest")], "left_anti")
    return responses.withColumn("refers_to", F.lit(None).cast("bigint")).unionByName(revisits.withColumn("payload", F.lit("")).select(*columns, "refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {EPOCH}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "%0A", url))
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is None:
        lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    else:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}", "Content-Length: 0"]
        payload = b""
    return "\r\n".join(lines).encode() + END + payload + END


def archives(resolved: DataFrame, file_bytes: int = FILE_BYTES) -> DataFrame:
    """value: the bytes of one archive file a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members: list[bytes] = []
        held = 0
        for batch in batches:
            payloads = batch.column("payload").cast(pa.binary())
            for page_id, url, digest, refers_to, payload in zip(*[batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")], payloads, strict=True):
                member = gzip.compress(record(page_id, url, payload.as_py(), digest, refers_to), 6, mtime=0)
                if members and held + len(member) > file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])
                    members, held = [], 0
                members.append(member)
                held += len(member)
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])

    return resolved.select("page_id", "url", "digest", "refers_to", "payload").mapInArrow(run, "value binary")


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, broadcast_rows: int = BROADCAST_ROWS) -> None:
    """Write deduplicated archives, gzip files under ``path``."""
    files = archives(resolve(pages, broadcast_rows), file_bytes)
    # a cast of bytes to text keeps them as they are; ISO-8859-1 is of the separator alone
    files.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).mode("errorifexists").text(path)


def unzipped(content: bytes) -> Iterator[bytes]:
    """The members of a gzip file, one at a time, without empty ones."""
    at, view = 0, memoryview(content)
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            piece = view[at : at + PIECE_BYTES]
            if not piece:
                raise ValueError("an archive ends within a member")
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        if data := b"".join(parts):
            yield data


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record."""
    stop = member.index(END)
    lines = member[:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start, size = stop + len(END), int(head["Content-Length"])
    if member[start + size :] != END:
        raise ValueError(f"{head['WARC-Record-ID']}: its block doesn't end at its length")
    return head, member[start : start + size]


READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("html", pa.string())])
READ_SQL = "page_id bigint, url string, record_type string, payload_digest string, refers_to bigint, payload_bytes bigint, html string"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives; a revisit has no payload_bytes and html until it is joined."""

    def page(urn: str | None) -> int | None:
        inner = (urn or "")[len("<urn:page:") : -1]
        return int(inner) if inner else None

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), READ, strict=True)], schema=READ)

        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for head, block in map(parse, unzipped(content.as_py())):
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    first = kind == "response"
                    if first and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"{head['WARC-Record-ID']}: its payload doesn't have its digest")
                    rows.append((page(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), kind, digest, page(head.get("WARC-Refers-To")), len(block) if first else None, block.decode() if first and payloads else None))
                    held += 200 + (len(block) if payloads else 0)
                    if held > BATCH_BYTES:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parsed, READ_SQL)


def resolved_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record with the full payload's length (and html): revisit headers are shuffled by
    digest to the responses they refer to."""
    found = read_archives(spark, path, payloads)
    if not payloads:
        found = spool(found, "op2-headers")
    revisits = spool(found.where("record_type = 'revisit'").select("payload_digest", "refers_to").distinct(), "op2-revisits")
    responses = found.where("record_type = 'response'")
    wanted = revisits.withColumnRenamed("refers_to", "page_id")
    originals = join_spooled(responses, wanted, ["payload_digest", "page_id"], "left_semi").select("payload_digest", F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes"), F.col("html").alias("full_html"))
    originals = spool(originals.dropDuplicates(["payload_digest", "refers_to"]), "op2-originals")
    discard(revisits)
    # originals hold payloads only where these are asked for
    n, size = originals.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("full_html")), F.lit(0))).first()
    small = n <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    joined = found.join(F.broadcast(originals) if small else originals, ["payload_digest", "refers_to"], "left")
    return joined.select("page_id", "url", F.coalesce("payload_bytes", "full_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.coalesce("html", "full_html").alias("html"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back, revisits resolved."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/op2-archives-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return resolved_archives(spark, path)


ORACLE_SQL = f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY digest) AS first_id FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= {MIN_BYTES} AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_BYTES} AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM f
"""
