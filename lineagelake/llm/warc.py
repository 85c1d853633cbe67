"""WARC archives as a chunked record table.

``chunk_table`` streams each payload as rows (record, chunk number, piece): a payload of more than
``CHUNK_BYTES`` is cut into several, straight from the buffer in which Arrow hands it over, and the
digest and the length are carried from chunk to chunk.  A record of several chunks becomes a segmented
WARC record: the first piece under ``response``, the others under ``continuation``; the last states
the payload's digest and length.  Neither writing nor reading puts chunks together again.

Archives are written and read by Spark's text source, which gives atomic commits and, as they
are not compressed, files that many tasks can split: a record's last CRLF CRLF is the line separator, and the
reader's separator is that plus the next record's version line.  Payload pieces are cut
inside that version line, so it never occurs within a record.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, materialize, shared_dir, shuffle_partitions

VERSION, END = "WARC/1.1\r\n", "\r\n\r\n"
CHUNK_BYTES = 1 << 18
#: Bytes of pieces, about, that one batch of chunk rows holds.
BATCH_BYTES = 4 << 20
#: Payloads of fewer bytes are never replaced by a revisit.
MIN_REVISIT_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: Column) -> Column:
    """Bare upper-case base32 of a 40-digit hexadecimal SHA-1, five digits (four letters) at a time."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    group = lambda k: F.conv(F.substring(digest, k * 5 + 1, F.lit(5)), 16, 10).cast("int")
    four = lambda v: F.concat(*(F.substring(letters, F.shiftright(v, n).bitwiseAND(31) + 1, F.lit(1)) for n in (15, 10, 5, 0)))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: four(group(k))), "")


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def pieces_of(payload: memoryview, chunk_bytes: int) -> Iterator[memoryview]:
    """Slices of ``payload`` (UTF-8) of at most ``chunk_bytes`` bytes, whole characters each (one where a
    character is longer), that do not hold the version line; nothing is copied but a chunk at a time."""
    at, n, mark = 0, len(payload), VERSION.encode()
    while at < n or n == 0:
        end = min(at + chunk_bytes, n)
        while end < n and end > at and payload[end] & 0xC0 == 0x80:
            end -= 1
        if end == at:  # a character longer than a chunk
            end = min(at + 1, n)
            while end < n and payload[end] & 0xC0 == 0x80:
                end += 1
        found = bytes(payload[at:end]).find(mark)
        if found >= 0:
            end = at + found + 1
        yield payload[at:end]
        at = end
        if n == 0:
            return


CHUNK_SCHEMA = "record bigint, page_id bigint, url string, chunk int, last boolean, size bigint, digest string, piece binary"


def chunk_table(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(record, page_id, url, chunk, last, size, digest, piece): the payloads as chunk rows.

    ``size`` runs over a record's chunks; its last one has the whole payload's length and SHA-1
    (base32), carried incrementally.  A null html is an empty payload, which is one empty chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("size", pa.int64()), ("digest", pa.string()), ("piece", pa.binary())])
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for record, page, url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                payload = memoryview(html.as_buffer()) if html.is_valid else memoryview(b"")
                sha, size = hashlib.sha1(), 0
                for chunk, piece in enumerate(pieces_of(payload, chunk_bytes)):
                    sha.update(piece)
                    size += len(piece)
                    last = size == len(payload)
                    rows.append((record, page, url, chunk, last, size, base64.b32encode(sha.digest()).decode() if last else None, bytes(piece)))
                    held += len(piece)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return map_batches(pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("bigint").alias("page_id"), "url", "html"), run, CHUNK_SCHEMA)


def plan_revisits(chunks: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(record, refers_to, refers_to_record): the records that are revisits.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the largest
    page_id (null is lowest; of repeated ones, the first) is the response and the others refer to it.
    """
    ends = chunks.where(F.col("last") & (F.col("size") >= min_bytes)).select("record", "page_id", "size", "digest")
    # only payloads that several records have; written, so that the join below can split a hot one
    first = ends.groupBy("digest", "size").agg(F.max(F.struct("page_id", (-F.col("record")).alias("neg"))).alias("r"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first.select("digest", "size", F.col("r.page_id").alias("refers_to"), (-F.col("r.neg")).alias("refers_to_record")), "warc-first")
    return ends.join(first, ["digest", "size"]).where("record <> refers_to_record").select("record", "refers_to", "refers_to_record")


def _record_id(record: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), record.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = MIN_REVISIT_BYTES, chunk_bytes: int = CHUNK_BYTES, date: str | None = None) -> None:
    """Write one WARC record (or its segments) per page to ``path``, dated ``date`` (now, if not given).

    A null html is an empty payload; a null url is written as an empty target.  The chunk table
    is written once; payloads go from there to the archive without a shuffle unless the
    plan of revisits is too large for Spark to broadcast.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    chunks = materialize(chunk_table(pages, chunk_bytes), "warc-chunks", "zstd")
    plan = materialize(plan_revisits(chunks, min_bytes), "warc-plan")
    rows = chunks.join(plan, "record", "left")
    uri = F.coalesce(F.regexp_replace("url", "[\r\n]", ""), F.lit(""))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    head = [F.lit(f"{VERSION}WARC-Date: {date}\r\nWARC-Page-ID: "), page, F.lit("\r\n")]
    whole = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\nWARC-Payload-Length: "), F.col("size").cast("string"), F.lit("\r\n"))
    own, text = _record_id(F.col("record")), lambda c: F.when(c, F.lit(""))
    several = (F.col("chunk") > 0) | ~F.col("last")
    response = F.concat(
        *head,
        F.when(F.col("chunk") == 0, F.concat(F.lit("WARC-Type: response\r\nWARC-Record-ID: "), own, F.lit("\r\nWARC-Target-URI: "), uri, F.lit("\r\n"))).otherwise(
            F.concat(F.lit("WARC-Type: continuation\r\nWARC-Record-ID: <urn:record:"), F.col("record").cast("string"), F.lit(":"), F.col("chunk").cast("string"), F.lit(">\r\nWARC-Segment-Origin-ID: "), own, F.lit("\r\n"))
        ),
        text(~several).otherwise(F.concat(F.lit("WARC-Segment-Number: "), (F.col("chunk") + 1).cast("string"), F.lit("\r\n"))),
        text(~several | ~F.col("last")).otherwise(F.concat(F.lit("WARC-Segment-Total-Length: "), F.col("size").cast("string"), F.lit("\r\n"))),
        text(~F.col("last")).otherwise(whole),
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length("piece").cast("string"), F.lit(END), F.col("piece").cast("string"),
    )
    target = F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))
    revisit = F.concat(*head, F.lit("WARC-Type: revisit\r\nWARC-Record-ID: "), own, F.lit("\r\nWARC-Target-URI: "), uri, F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), _record_id(F.col("refers_to_record")), F.lit("\r\nWARC-Refers-To-Page-ID: "), target, F.lit("\r\n"), whole, F.lit("Content-Length: 0"), F.lit(END))
    is_response = F.col("refers_to_record").isNull()
    rows.where(is_response | F.col("last")).select(F.when(is_response, response).otherwise(revisit).alias("value")).write.option("lineSep", END).text(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archive's record table: (page_id, record, type, refers_to, chunk, digest, bytes, payload): a row
    per record or segment; a segment that is not the last has no digest and length."""
    value, first = F.col("value"), VERSION
    lines = spark.read.option("lineSep", END + VERSION).text(path)
    rest = F.when(value.startswith(first), F.substring(value, len(first) + 1, 1 << 30)).otherwise(value)
    cut = lines.select(rest.alias("rest")).select("rest", F.substring_index("rest", END, 1).alias("head")).select("rest", "head", F.str_to_map("head", F.lit("\r\n"), F.lit(": ")).alias("h"))
    get = lambda name: F.col("h")[name]
    body = F.expr(f"substring(CAST(rest AS binary), octet_length(head) + {len(END) + 1}, CAST(h['Content-Length'] AS int))")
    return cut.select(
        get("WARC-Page-ID").try_cast("long").alias("page_id"),
        F.coalesce(get("WARC-Segment-Origin-ID"), get("WARC-Record-ID")).alias("record"),
        get("WARC-Type").alias("type"),
        get("WARC-Refers-To-Page-ID").try_cast("long").alias("refers_to"),
        F.coalesce(get("WARC-Segment-Number").cast("int"), F.lit(0)).alias("chunk"),
        F.regexp_replace(get("WARC-Payload-Digest"), "^sha1:", "").alias("digest"),
        get("WARC-Payload-Length").cast("long").alias("bytes"),
        body.alias("payload"),
    )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest of a response are computed from what was read; those of a revisit are
    the ones it states for the payload it refers to.  A response whose payload does not
    give its stated digest raises.
    """
    chunks = read_chunks(spark, path)
    whole = chunks.where("type = 'response' AND chunk = 0").select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), _once(F.sha1("payload"), base32).alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "digest")
    # segments of a record come together in order; a task holds one segment at a time
    parts = chunks.where("chunk > 0").select("record", "chunk", "page_id", "digest", "payload").repartition(shuffle_partitions(spark), "record").sortWithinPartitions("record", "chunk")
    long = map_batches(parts, _carry, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, digest string")
    responses = whole.unionByName(long)
    wrong = F.raise_error(F.concat(F.lit("payload digest differs: page "), F.col("page_id").cast("string")))
    checked = responses.withColumn("payload_digest", _once(F.col("payload_digest"), lambda d: F.when(d == F.col("digest"), d).otherwise(wrong)))
    revisits = chunks.where("type = 'revisit'").select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to", "digest")
    return checked.unionByName(revisits).drop("digest")


def _carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest and length of each record from its sorted chunks, carried over batches."""
    now, sha, size, page, digest = None, None, 0, None, None

    def done() -> pa.RecordBatch:
        bare = base64.b32encode(sha.digest()).decode()
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((page, size, bare, "response", None, digest), types)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest"])

    for b in batches:
        for record, page_id, stated, payload in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4)):
            if record != now:
                if now is not None:
                    yield done()
                now, sha, size, page = record, hashlib.sha1(), 0, page_id
            digest = stated  # the last segment's
            piece = payload.as_buffer()
            sha.update(piece)
            size += piece.size
    if now is not None:
        yield done()


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read it back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, min_bytes, chunk_bytes)
    return read_records(spark, path)
