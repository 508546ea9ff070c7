"""WARC archives: writing pages, and reading records back from segments.

Writing: one record a row. Payloads of ``least_bytes`` or more that are equal
are stored once, by the row with the largest page_id; the others become
``revisit`` records that refer to it. A record whose block is longer than
``segment_bytes`` goes into a first segment and ``continuation`` records.
Bodies have chunked transfer framing. Spark's text writer makes the files
(gzip), so that they go where the session's file systems reach and a task that
is run again replaces what it wrote.

Reading: files are cut at the line that begins each record, wherever a split
falls. Segments are grouped by the identifier of the record they continue,
whatever file holds them, ordered by number and streamed through a task that
holds one record at a time; their count and total length are verified before
the chunked framing is taken off. Whole records are not shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import groupby
from operator import itemgetter
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortfold.llm.shared import Scratch, map_arrow, parallelism
from cohortfold.llm.words import slices

SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 1 << 13
LEAST_BYTES = 1000
#: What begins a record; no block that is written here holds it.
_MARK = b"WARC/1."
_CUT = "\r\n" + _MARK.decode()
_END = "\r\n\r\n"
#: Field that carries the row's page_id; the format lets readers skip fields they do not know.
_PAGE = "Page-ID"
_BATCH_BYTES = 2 << 20
_SAFE = "!#$%&'()*+,/:;=?@[]~"


def _batches(rows: Iterator[dict], schema: str, bulk: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of bounded size; the bytes are in column ``bulk``."""
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    batch = lambda held: pa.record_batch([pa.array([r.get(n) for r in held], kinds[t]) for n, t in columns], names=[n for n, _ in columns])
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get(bulk) or b"") + 500
        if size > _BATCH_BYTES:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def _chunked(payload: bytes, chunk_bytes: int) -> bytes:
    """Chunked framing; chunks also end inside each ``_MARK``."""
    cuts = {m.start() + 2 for m in re.finditer(re.escape(_MARK), payload)}
    cuts.update(range(chunk_bytes, len(payload), chunk_bytes))
    out, at = [], 0
    for cut in sorted(cuts | {len(payload)}):
        if cut > at:
            out += [b"%x\r\n" % (cut - at), payload[at:cut], b"\r\n"]
            at = cut
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """The content of a chunked body; None if its framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        begin, length = end + 2, int(size, 16)
        if not length:
            return b"".join(out)  # trailing fields are of no interest
        at = begin + length
        if body[at:at + 2] != b"\r\n":
            return None
        out.append(body[begin:at])
        at += 2


def payload_of(block: bytes, content_type: str | None) -> bytes | None:
    """What a record's block carries: the body of an HTTP response without its
    transfer framing (None if that is broken), or the block itself."""
    if not (content_type or "").lower().startswith("application/http"):
        return block
    head, _, body = block.partition(b"\r\n\r\n")
    coding = re.search(rb"(?im)^transfer-encoding:[^\r\n]*\bchunked\b", head)
    return unchunked(body) if coding else body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _record_id(page: str | None, row: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page}\n{row}\n{digest}'.encode()).digest())}>"


def _writing(date: str, segment_bytes: int, chunk_bytes: int):
    def records(row: dict) -> Iterator[bytes]:
        own = _record_id(row["page"], row["row"], row["digest"])
        common = [
            ("WARC-Date", date), ("WARC-Target-URI", None if row["url"] is None else quote(row["url"], safe=_SAFE)),
            (_PAGE, None if row["page"] is None else quote(row["page"], safe=_SAFE)),
        ]
        digest = "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()
        kind = ("Content-Type", "application/http; msgtype=response")
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
        if row["revisits"]:
            yield _record([
                ("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest),
                ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                ("WARC-Refers-To", _record_id(row["kept_page"], row["kept_row"], row["digest"])), kind,
            ], http)
            return
        block = http + _chunked(row["html"].encode(), chunk_bytes)
        parts = [block[at:at + segment_bytes] for at in range(0, len(block), segment_bytes)]
        first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), kind]
        yield _record(first + [("WARC-Segment-Number", 1)] * (len(parts) > 1), parts[0])
        for k, part in enumerate(parts[1:], 2):
            yield _record([
                ("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{k}>"), *common, ("WARC-Segment-Origin-ID", own),
                ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", len(block) if k == len(parts) else None),
            ], part)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for piece in slices(batch, "html", _BATCH_BYTES) for row in piece.to_pylist())
        yield from _batches(({"value": record} for row in rows for record in records(row)), "value binary", "value")

    return write


def write_archives(
    pages: DataFrame, path: str, *, least_bytes: int = LEAST_BYTES, segment_bytes: int = SEGMENT_BYTES,
    chunk_bytes: int = CHUNK_BYTES, date: str | None = None,
) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) under ``path``.

    The payload is the html in UTF-8, empty if null. A null url or page_id is
    left out of the record. Of rows with the same payload and the same
    page_id, one is kept as the response; a null page_id counts as the
    smallest. Other columns are not written. No rows: files without records.
    ``segment_bytes`` bounds a record's block, ``date`` is the records' date
    (now, if not given).
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    rows = scratch.write(rows, "rows")  # fixes the row numbers
    same = rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(
        F.max(F.struct("page_id", "row")).alias("kept"), F.count(F.lit(1)).alias("copies")
    )
    same = same.filter("copies > 1").select("digest", F.col("kept.page_id").cast("string").alias("kept_page"), F.col("kept.row").alias("kept_row"))
    same = scratch.write(same, "same")  # its size is known then: few copies need no shuffle of payloads
    rows = rows.join(same, "digest", "left")
    revisits = F.col("kept_row").isNotNull() & (F.col("kept_row") != F.col("row"))
    rows = rows.select(
        F.col("page_id").cast("string").alias("page"), "url", F.when(~revisits, F.col("html")).alias("html"), "row", "digest",
        "kept_page", "kept_row", revisits.alias("revisits"),
    )
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    records = map_arrow(rows, _writing(date, segment_bytes, chunk_bytes), "value binary")
    records.select(F.col("value").cast("string")).write.option("lineSep", _END).option("compression", "gzip").text(path)
    scratch.drop("rows", "same")


_FIELDS = {
    "record_id": "warc-record-id", "type": "warc-type", "date": "warc-date", "target_uri": "warc-target-uri", "page_id": _PAGE.lower(),
    "refers_to": "warc-refers-to", "stated_digest": "warc-payload-digest", "content_type": "content-type",
    "origin_id": "warc-segment-origin-id", "segment": "warc-segment-number", "total": "warc-segment-total-length",
}
_PARTS = "record_id string, type string, date string, target_uri string, page_id string, refers_to string, stated_digest string, content_type string, origin_id string, segment long, total long, status string, block binary"
_RECORDS = "record_id string, type string, date string, target_uri string, page_id string, refers_to string, stated_digest string, status string, payload binary"


def _number(text: str | None) -> int | None:
    return int(text) if text and text.strip().isdigit() else None


def _hex_digest(text: str | None) -> str | None:
    """Lower-case hex of a ``sha1:`` field in base 32 or hex; other digests unchanged."""
    name, _, value = (text or "").strip().partition(":")
    if name.lower() == "sha1" and len(value) == 32:
        return base64.b32decode(value.upper()).hex()
    return value.lower() if name.lower() == "sha1" else text


def _parsed(piece: bytes) -> tuple[dict, int | None] | None:
    """A record's fields and block, and how many bytes of it are missing; None if it is none."""
    head, _, block = piece.partition(b"\r\n\r\n")
    first, *lines = re.sub(r"\r\n[ \t]+", " ", head.decode("utf-8", "replace")).split("\r\n")
    named = dict(line.split(":", 1) for line in lines if ":" in line)
    named = {k.strip().lower(): v.strip() for k, v in named.items()}
    length = _number(named.get("content-length"))
    if not first.strip().isdigit() or length is None:
        return None
    fields = {out: named.get(name) for out, name in _FIELDS.items()}
    fields |= {"segment": _number(fields["segment"]), "total": _number(fields["total"]), "stated_digest": _hex_digest(fields["stated_digest"])}
    fields |= {k: unquote(fields[k]) for k in ("page_id",) if fields[k] is not None}
    return fields | {"status": "ok", "block": block[:length]}, max(0, length - len(block))


def _records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Records from the pieces between marks. A record whose payload holds the
    mark comes in several pieces; its length says how many."""
    held, file = b"", None

    def cut() -> Iterator[dict]:
        if held:
            found = _parsed(held)
            yield (found[0] | {"status": "truncated"}) if found else {"status": "malformed"}

    for batch in batches:
        for value, source in zip(batch.column("value"), batch.column("file")):
            piece, source = value.as_py(), source.as_py()
            if source != file:
                yield from cut()
                held, file = b"", source
            if piece.startswith(_MARK):  # a file's first record
                piece = piece[len(_MARK):]
            if not held and not piece.strip():
                continue
            held = held + _CUT.encode() + piece if held else piece
            found = _parsed(held)
            if found and found[1]:
                continue
            yield found[0] if found else {"status": "malformed"}
            held = b""
    yield from cut()


def _decoded(fields: dict) -> dict:
    """The record's payload in place of its block."""
    out = {k: fields.get(k) for k in ("record_id", "type", "date", "target_uri", "page_id", "refers_to", "stated_digest", "status")} | {"payload": None}
    if out["status"] == "ok" and out["type"] != "revisit":
        out["payload"] = payload_of(fields["block"], fields["content_type"])
        if out["payload"] is None:
            out["status"] = "bad framing"
    return out


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    whole = (fields for fields in _records_of(batches) if fields.get("segment") is None)
    yield from _batches(map(_decoded, whole), _RECORDS, "payload")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = (fields for fields in _records_of(batches) if fields.get("segment") is not None)
    yield from _batches((fields | {"origin_id": fields["origin_id"] or fields["record_id"]} for fields in parts), _PARTS, "block")


def _reassembled(segments: list[dict]) -> dict:
    """One record from its segments in order; a segment that is there twice counts once."""
    by_number = {s["segment"]: s for s in segments}
    first, last = segments[0], segments[-1]
    block = b"".join(s["block"] for s in by_number.values())
    if any(s["block"] != by_number[s["segment"]]["block"] for s in segments):
        status = "segments disagree"
    elif any(s["status"] != "ok" for s in segments):
        status = "truncated"
    elif first["segment"] != 1 or len(by_number) != last["segment"] or last["total"] is None:
        status = "segments missing"
    else:
        status = "ok" if last["total"] == len(block) else "wrong total length"
    named = first if first["segment"] == 1 else first | {"record_id": first["origin_id"]}
    return _decoded(named | {"status": status, "block": block})


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (row for batch in batches for k in range(0, batch.num_rows, 64) for row in batch.slice(k, 64).to_pylist())
    records = (_reassembled(list(group)) for _, group in groupby(rows, key=itemgetter("origin_id")))
    yield from _batches(records, _RECORDS, "payload")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records under ``path``: record_id, type, date, target_uri, page_id,
    refers_to (a record_id), stated_digest (hex), status, payload.

    A record in segments comes once, under its first segment's identifier.
    ``status`` is ``ok`` or why there is no payload: ``truncated``,
    ``malformed``, ``segments missing``, ``segments disagree``, ``wrong total
    length`` or ``bad framing``. A revisit has no payload of its own. Fields a
    record lacks are null; no records: no rows. Archives of others are read
    too, plain or gzip; where their payloads hold the line that begins a
    record, files must not be split (gzip), for the pieces to be joined again.
    """
    pieces = spark.read.option("lineSep", _CUT).text(path).select(F.col("value").cast("binary").alias("value"), F.input_file_name().alias("file"))
    segments = map_arrow(pieces, _segments, _PARTS)
    segments = segments.repartition(parallelism(spark), "origin_id").sortWithinPartitions("origin_id", "segment")
    return map_arrow(pieces, _whole, _RECORDS).unionByName(map_arrow(segments, _reassemble, _RECORDS))


def resolved(records: DataFrame) -> DataFrame:
    """Responses and revisits of ``read_archives`` without payloads: record_id,
    page_id, record_type, payload_bytes, payload_digest, refers_to (the
    response's page_id), status.

    Bytes and digest of a response are its payload's; a revisit has the bytes
    of the response it refers to (null if there is none) and the digest it states.
    """
    scratch = Scratch(records.sparkSession)
    told = records.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", "page_id", F.col("type").alias("record_type"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), F.col("stated_digest")).alias("payload_digest"), "refers_to", "status",
    )
    told = scratch.write(told, "records")
    responses = told.filter("record_type = 'response'")
    targets = responses.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("_page"), F.col("payload_bytes").alias("_bytes"))
    revisits = told.filter("record_type = 'revisit'").drop("payload_bytes").join(targets, "refers_to", "left").select(
        "record_id", "page_id", "record_type", F.col("_bytes").alias("payload_bytes"), "payload_digest", F.col("_page").alias("refers_to"), "status"
    )
    return responses.withColumn("refers_to", F.lit(None).cast("string")).select(revisits.columns).unionByName(revisits)
