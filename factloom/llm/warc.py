"""WARC archives: pages written as segmented, chunked records, and read back by joining the
segments of each record."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import slices, small_side

CRLF, GZIP = b"\r\n", b"\x1f\x8b"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """A block over ``segment`` bytes is cut into continuation records; bodies are sent in
    chunks of ``chunk`` bytes; a file has ``records`` records at most. A list of at most
    ``broadcast_rows`` repeated payloads is sent to all executors, a longer one is shuffled."""

    segment: int = 1024
    chunk: int = 700
    records: int = 20_000
    broadcast_rows: int = 200_000
    date: str = "2024-01-01T00:00:00Z"


def base32_sha1(payload) -> F.Column:
    """Bare upper-case base32 of the SHA-1: 40 bits are eight characters."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), *BASE32)


def verdicts(pages: DataFrame) -> DataFrame:
    """(digest, page_id, url, copies, head): distinct pages with the number of equal rows;
    ``head`` on the one of each payload that is written out, with the largest page_id, then url."""
    keys = pages.groupBy("digest", "page_id", "url").agg(F.count("*").alias("copies"))
    heads = keys.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("top"))
    own = F.struct("page_id", "url")
    return keys.join(heads, "digest").select("digest", "page_id", "url", "copies", own.eqNullSafe(F.col("top")).alias("head"))


def chunked(payload: bytes, size: int) -> bytes:
    parts = [payload[k:k + size] for k in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload in chunked transfer framing. Chunk extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size:at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at:at + size])
        at += size + 2


def record(kind: str, name: str, block: bytes, date: str, **fields) -> bytes:
    """One record without the two line ends that close it; the file writer puts them there."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    lines += [f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + CRLF + CRLF + block


def response_records(pages: DataFrame, a: Archive) -> DataFrame:
    """(record) of (page_id, url, digest, payload): the response and its continuations."""
    def run(batches):
        for batch in slices(batches, "payload"):
            out = []
            for page_id, url, digest, payload in zip(*(batch.column(k).to_pylist() for k in range(4))):
                name = f"urn:sha1:{digest}"
                block = HTTP + chunked(payload.encode(), a.chunk)
                parts = [block[k:k + a.segment] for k in range(0, len(block), a.segment)]
                more = len(parts) > 1
                out.append(record("response", name, parts[0], a.date, WARC_Target_URI=uri(url), X_Page_ID=page_id,
                                  WARC_Payload_Digest=f"sha1:{digest}", WARC_Segment_Number=1 if more else None))
                for k, part in enumerate(parts[1:], 2):
                    out.append(record("continuation", f"{name}:{k}", part, a.date, WARC_Segment_Origin_ID=f"<{name}>", WARC_Segment_Number=k,
                                      WARC_Segment_Total_Length=len(block) if k == len(parts) else None))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return pages.select("page_id", "url", "digest", "payload").mapInArrow(run, "record binary")


def uri(url: str | None) -> str | None:
    """A header value must stay on one line."""
    return None if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")


def revisit_records(pages: DataFrame, a: Archive) -> DataFrame:
    """(record) of (page_id, url, digest, copy)."""
    def run(batches):
        for batch in batches:
            out = []
            for page_id, url, digest, copy in zip(*(batch.column(k).to_pylist() for k in range(4))):
                named = hashlib.md5(repr((page_id, url, digest, copy)).encode()).hexdigest()
                out.append(record("revisit", f"urn:md5:{named}", HTTP, a.date, WARC_Target_URI=uri(url), X_Page_ID=page_id,
                                  WARC_Payload_Digest=f"sha1:{digest}", WARC_Profile=PROFILE, WARC_Refers_To=f"<urn:sha1:{digest}>"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return pages.select("page_id", "url", "digest", "copy").mapInArrow(run, "record binary")


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", archive: Archive = Archive()) -> None:
    """Write one record per row of ``pages`` to gzipped WARC files in the folder ``path``.

    The payload is the html in UTF-8, null as empty. Of equal payloads the row with the
    largest page_id is a response, the others are revisits that refer to it; null page_ids
    are smallest, and of several rows alike in all columns one is the response. Other
    columns are ignored. No rows write no records.
    """
    base = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("payload"))
    base = base.withColumn("digest", base32_sha1(F.col("payload").cast("binary")))
    known = cut_lineage(verdicts(base.drop("payload")), "verdicts")
    # Only payloads that occur again have to be chosen from; the others never move.
    again = known.groupBy("digest").agg(F.sum("copies").alias("rows"), F.max(F.when(F.col("head"), F.struct("page_id", "url"))).alias("top"))
    again = small_side(cut_lineage(again.where("rows > 1").select("digest", "top"), "again"), archive.broadcast_rows)
    own = F.struct("page_id", "url")
    chosen = base.join(again, "digest").where(own.eqNullSafe(F.col("top"))).drop("top").dropDuplicates(["digest"])
    alone = base.join(again.select("digest"), "digest", "left_anti")
    responses = response_records(alone.select(*base.columns).union(chosen.select(*base.columns)), archive)
    more = known.withColumn("times", F.col("copies") - F.col("head").cast("long")).where("times > 0")
    revisits = revisit_records(more.select("page_id", "url", "digest", F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy")), archive)
    # A record ends with two line ends, which the text writer appends to each row as it is.
    responses.union(revisits).select(F.col("record").cast("string").alias("value")).write.option(
        "lineSep", "\r\n\r\n").option("maxRecordsPerFile", archive.records).option("compression", "gzip").text(path)


def records_in(content: bytes):
    """(headers, block) of each record, cut by the lengths that the records state."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = dict(re.split(r":\s*", line, maxsplit=1) for line in lines[1:])
        fields = {k.lower(): v for k, v in fields.items()}
        start = end + 4
        stop = start + int(fields["content-length"])
        if content[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        yield fields, content[start:stop]
        at = stop + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, kind, origin, segment, total, page_id, refers_to, digest, block) of all
    records in the files of ``path``. A file is read as a whole, so files must be bounded."""
    def bare(value):
        return value.strip("<>") if value else None

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                raw = content.as_py()
                for f, block in records_in(gzip.decompress(raw) if raw[:2] == GZIP else raw):
                    name, number = bare(f["warc-record-id"]), f.get("warc-segment-number")
                    rows.append((name, f["warc-type"], bare(f.get("warc-segment-origin-id")) or name, int(number or 1),
                                 int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None if number else len(block),
                                 int(f["x-page-id"]) if "x-page-id" in f else None, bare(f.get("warc-refers-to")),
                                 f.get("warc-payload-digest", "").removeprefix("sha1:"), block))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(column, kind) for column, kind in zip(zip(*rows), KINDS)], names=NAMES)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(
        run, "record_id string, kind string, origin string, segment int, total long, page_id long, refers_to string, digest string, block binary")


NAMES = ["record_id", "kind", "origin", "segment", "total", "page_id", "refers_to", "digest", "block"]
KINDS = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]


WHOLE = ["origin", "page_id", "payload", "payload_bytes", "payload_digest", "problem"]


def reassembled(records: DataFrame, payloads: bool = True) -> DataFrame:
    """(origin, page_id, payload, payload_bytes, payload_digest, problem): the responses among
    ``records``, put together from their segments; the payload itself only if ``payloads``. ``problem`` names what is wrong with a
    record: a missing or repeated segment, a wrong total length, bad framing, a wrong digest."""
    parts = records.where(F.col("kind").isin("response", "continuation")).groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("total").alias("total"), F.max("digest").alias("digest"),
        F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("parts"))

    def joined(parts, total, digest):
        numbers = [p["segment"] for p in parts]
        if numbers != list(range(1, len(parts) + 1)):
            raise ValueError(f"segments {numbers[:20]}")
        block = b"".join(p["block"] for p in parts)
        if total != len(block):
            raise ValueError(f"{len(block)} bytes, total length {total}")
        head, _, body = block.partition(b"\r\n\r\n")
        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
        made = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if digest and digest != made:
            raise ValueError(f"digest {made}, stated {digest}")
        return payload, made

    kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for row in batch.to_pylist():
                payload, made, problem = None, None, None
                try:
                    payload, made = joined(row["parts"], row["total"], row["digest"])
                except ValueError as wrong:
                    problem = str(wrong)
                size = None if payload is None else len(payload)
                rows.append((row["origin"], row["page_id"], payload if payloads else None, size, made, problem))
                held += size or 0
                if held > 8 << 20 and payloads:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=WHOLE)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=WHOLE)

    return parts.mapInArrow(run, "origin string, page_id long, payload binary, payload_bytes long, payload_digest string, problem string")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per page of the archives in ``path``: page_id, payload_bytes, payload_digest,
    record_type, refers_to, problem. A revisit has the length of the response it refers to;
    ``problem`` tells why a payload could not be read, or that the response is missing."""
    records = read_records(spark, path)
    # Both branches below read it, so it is put together once.
    whole = cut_lineage(reassembled(records, payloads=False).drop("payload"), "reassembled")
    revisits = records.where("kind = 'revisit'").select("page_id", "refers_to", "digest")
    target = whole.select(F.col("origin").alias("refers_to"), F.col("page_id").alias("target"), "payload_bytes",
                          F.coalesce("problem", F.lit("")).alias("problem"))
    seen = revisits.join(target, "refers_to", "left").select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("target").alias("refers_to"),
        F.nullif(F.coalesce("problem", F.lit("the response is missing")), F.lit("")).alias("problem"))
    return whole.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
                        F.lit(None).cast("long").alias("refers_to"), "problem").union(seen)
