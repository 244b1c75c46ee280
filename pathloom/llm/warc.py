"""WARC archives: writing with revisit records and segmentation, and reading back.

``write_warc`` writes one response or revisit record per page, and a warcinfo
record at the start of every task's output. The payload goes out as an HTTP
message in chunked transfer framing; a message longer than ``segment_bytes`` is
cut into a first record and continuation records. Archives are written and split
for reading by Spark, so any file system of Spark's will do. Uncompressed files
are read by several tasks each; a compressed file by one, so ``records_per_file``
bounds what one task reads.

``read_warc`` parses the records, groups continuations by their origin
identifier, orders them by segment number, verifies the total length, decodes
the chunked framing and verifies the payload digest; revisits get the figures of
the response that they refer to. Blocks are bytes throughout. A record's page is
its field ``X-Page-ID``; archives of others have none, and their pages are null
with the target URI beside them.

The text ``WARC/1.1`` at a line's end starts a record. A payload that has
``WARC/1.1`` anywhere is cut into chunks inside of it, so no record's block can
hold it, nor end with it; at a url's end its point is percent-encoded. An archive
of others whose blocks hold it is refused by the length check.

Every record has an identifier of its own, so repeated rows stay apart through
segmentation and reassembly. It is derived from the page, the payload and, where
the payload's largest page_id stands in several rows, the place where it is
written; those rows are responses each, and revisits name that page, but no
single record.

Defined results: null html is an empty payload; a null identifier is written as
``null``; a null url is written as an empty one, control characters in a url are
percent-encoded; an empty table gives an archive without page records and an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import scratch

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts: object) -> str:
    return uuid.uuid5(uuid.NAMESPACE_URL, "|".join(map(str, parts))).urn


def _cuts(data: bytes, size: int, extra: list[int]) -> list[int]:
    """Ends of pieces of at most ``size`` bytes that keep UTF-8 sequences whole, and cuts at ``extra``."""
    out, at, extra = [], 0, [*extra, len(data)]
    for stop in extra:
        while stop - at > size:
            end = at + size
            while end > at + 1 and data[end] & 0xC0 == 0x80:
                end -= 1
            out.append(end)
            at = end
        if stop > at:
            out.append(stop)
            at = stop
    return out


def encode_chunked(payload: bytes, chunk_bytes: int) -> bytes:
    out, at = [], 0
    for end in _cuts(payload, chunk_bytes, [m.start() + 3 for m in re.finditer(re.escape(MAGIC.strip().encode()), payload)]):
        out += [b"%x\r\n" % (end - at), payload[at:end], b"\r\n"]
        at = end
    return b"".join([*out, b"0\r\n\r\n"])


def decode_chunked(body: bytes) -> bytes:
    """Payload of a chunked body; extensions and trailers are skipped, broken framing raises."""
    out, at = [], 0
    while True:
        eol = body.index(b"\r\n", at)
        size = int(body[at:eol].split(b";")[0], 16)
        at = eol + 2
        if not size:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is not ended by CRLF")
        out.append(body[at : at + size])
        at += size + 2


def _record(kind: str, ident: str, date: str, fields: list[str], block: bytes) -> bytes:
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {date}", *fields, f"Content-Length: {len(block)}"]
    return (MAGIC + "\r\n".join(head) + "\r\n\r\n").encode() + block


def warcinfo(ident: str, date: str) -> bytes:
    return _record("warcinfo", ident, date, ["Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n")


def page_records(page_id: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool, segment_bytes: int, chunk_bytes: int, date: str, place: tuple = (), holders: int = 1) -> list[bytes]:
    """The records of one page. ``place`` tells rows apart where ``holders`` rows are the payload's responses, or the row is a revisit."""
    digest = digest32(payload)
    page = lambda i: "null" if i is None else str(i)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    uri = re.sub(r"WARC/1\.1\Z", "WARC/1%2E1", uri)
    fields = [f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-ID: {page(page_id)}"]
    if revisit:
        fields += [f"WARC-Profile: {_IDENTICAL}", f"X-Refers-To-Page-ID: {page(refers_to)}"]
        fields += [f"WARC-Refers-To: <{record_id(page(refers_to), digest)}>"] if holders == 1 else []
        return [_record("revisit", record_id(page(page_id), digest, "revisit", *place), date, fields, b"")]
    ident = record_id(page(page_id), digest, *(place if holders > 1 else ()))
    fields.append("Content-Type: application/http; msgtype=response")
    message = _HTTP + encode_chunked(payload, chunk_bytes)
    ends = _cuts(message, segment_bytes, [])
    if len(ends) == 1:
        return [_record("response", ident, date, fields, message)]
    out = [_record("response", ident, date, [*fields, "WARC-Segment-Number: 1"], message[: ends[0]])]
    for n, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True), 2):
        more = [f"WARC-Segment-Number: {n}", f"WARC-Segment-Origin-ID: <{ident}>"]
        if b == len(message):
            more.append(f"WARC-Segment-Total-Length: {len(message)}")
        out.append(_record("continuation", record_id(ident, n), date, more, message[a:b]))
    return out


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, segment_bytes: int = 32768, chunk_bytes: int = 8192, compression: str | None = "gzip", records_per_file: int = 20_000, date: str | None = None
) -> None:
    """Write the archives. Of equal payloads of ``min_bytes`` or more, the largest identifier's is the response."""
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    keyed = own.withColumn("digest", F.sha1("html")).withColumn("n", F.octet_length("html"))
    # from files, so that Spark can split a frequent payload's partition of the join; per page first, so that its rows meet combined
    per_page = keyed.groupBy("digest", "n", "page_id").agg(F.count(F.lit(1)).alias("rows"))
    held = per_page.groupBy("digest", "n").agg(F.max(F.struct("page_id", "rows")).alias("held")).select("digest", "n", F.col("held.page_id").alias("holder"), F.when(F.col("n") >= min_bytes, F.col("held.rows")).otherwise(2).alias("holders"))
    groups, groups_path = scratch.write(held, "payloads")
    decided = keyed.join(groups, ["digest", "n"]).select("page_id", "url", "html", "holder", ((F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("holder"))).alias("revisit"), "holders")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        out, held = [warcinfo(record_id("warcinfo", path, task), date)], 0
        for batch in batches:
            htmls = batch.column(2).cast(pa.binary())
            ids, urls, holders, revisits, times = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for i in range(batch.num_rows):
                out += (new := page_records(ids[i], urls[i], htmls[i].as_py(), holders[i], revisits[i], segment_bytes, chunk_bytes, date, (task, number), times[i]))
                number += 1
                held += sum(map(len, new))
                if held > 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], ["value"])

    writer = decided.mapInArrow(build, "value string").write.option("lineSep", END).option("maxRecordsPerFile", records_per_file)
    (writer.option("compression", compression) if compression else writer).text(path)
    scratch.remove(pages.sparkSession, groups_path)


def _header(block: bytes) -> tuple[dict[str, str], bytes]:
    """Fields by lower-case name, and the record's block."""
    head, _, rest = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n"))}
    size = int(fields["content-length"])
    if len(rest) < size:
        raise ValueError(f"{fields.get('warc-record-id')}: {len(rest)} of {size} bytes")
    return fields, rest[:size]


def _payload(message: bytes) -> bytes:
    head, _, body = message.partition(b"\r\n\r\n")
    return decode_chunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _page(value: str | None) -> int | None:
    return int(value) if value and value != "null" else None


_RECORDS = "ident string, page_id long, uri string, record_type string, refers_to long, digest string, payload_bytes long, segment int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per response, revisit or continuation; complete messages are decoded and verified, segments keep their block."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column(0):
                raw = value.as_py()
                if not raw:
                    continue
                fields, block = _header(raw)
                kind, ident, uri = fields["warc-type"], fields["warc-record-id"].strip("<>"), fields.get("warc-target-uri")
                page = _page(fields.get("x-page-id"))
                digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                if kind == "continuation":
                    total = fields.get("warc-segment-total-length")
                    rows.append((fields["warc-segment-origin-id"].strip("<>"), None, None, kind, None, None, None, int(fields["warc-segment-number"]), int(total) if total else None, block))
                elif kind == "revisit":
                    rows.append((ident, page, uri, kind, _page(fields.get("x-refers-to-page-id")), digest, None, None, None, None))
                elif kind == "response" and "warc-segment-number" in fields:
                    rows.append((ident, page, uri, kind, None, digest, None, 1, None, block))
                elif kind == "response":
                    payload = _payload(block)
                    if digest and digest32(payload) != digest:
                        raise ValueError(f"payload digest of {ident} differs")
                    rows.append((ident, page, uri, kind, None, digest32(payload), len(payload), None, None, None))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in _RECORDS.split(", ")])

    return spark.read.option("lineSep", MAGIC).text(path).where(F.col("value") != "").select(F.col("value").cast("binary")).mapInArrow(parse, _RECORDS)


def reassemble(segments: DataFrame) -> DataFrame:
    """Messages from segments (ident, page_id, segment, total, digest, block): grouped by origin, ordered, verified, decoded.

    A group is one message: the shuffle's group of segments is as large as the message that is decoded.
    """
    whole = segments.groupBy("ident").agg(F.max("page_id").alias("page_id"), F.max("digest").alias("digest"), F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("segment", "block"))).alias("parts"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, counts = [], []
            for ident, digest, total, parts in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                raw = b"".join(p["block"] for p in parts)
                numbers = [p["segment"] for p in parts]
                if numbers != list(range(1, len(parts) + 1)) or total != len(raw):
                    raise ValueError(f"{ident}: segments {numbers[:9]}, {len(raw)} of {total} bytes")
                payload = _payload(raw)
                if digest and digest32(payload) != digest:
                    raise ValueError(f"payload digest of {ident} differs")
                sizes.append(len(payload))
                counts.append(len(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(counts, pa.int32())], ["ident", "page_id", "digest", "payload_bytes", "segments"])

    return whole.mapInArrow(decode, "ident string, page_id long, digest string, payload_bytes long, segments int")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: (page_id, payload_bytes, payload_digest, record_type, refers_to, segments)."""
    records = scratch.materialise(read_records(spark, path), "warc-records")
    whole = records.where("segment IS NULL AND record_type = 'response'").select("page_id", "digest", "payload_bytes", F.lit(1).alias("segments"))
    parts = reassemble(records.where("segment IS NOT NULL")).select("page_id", "digest", "payload_bytes", "segments")
    responses = scratch.materialise(whole.unionByName(parts), "warc-responses")
    held = responses.groupBy(F.col("page_id").alias("holder"), "digest").agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = records.where("record_type = 'revisit'").select("page_id", "refers_to", "digest").alias("r")
    met = revisits.join(held.alias("h"), F.col("r.refers_to").eqNullSafe(F.col("h.holder")) & (F.col("r.digest") == F.col("h.digest")), "left")
    return responses.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "segments").unionByName(
        met.select("r.page_id", "h.payload_bytes", F.col("r.digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "r.refers_to", F.lit(0).alias("segments"))
    )
