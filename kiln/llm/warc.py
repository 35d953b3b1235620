"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with whole WARC records, and a footer: a skippable frame with
the seek table (compressed and plain size of every frame) of the seekable format. The index maps a record to its bundle,
frame, and offset and length within the frame's plain bytes, so that a reader decompresses one frame. Bundles are rows
of a table in the shared folder: Spark commits them, so a lost executor leaves nothing half-written. Their names deal
them to 256 shelves, folders of the table; fetch() reads the index of all and the content of the shelves it needs.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Plain bytes of records in a frame, and compressed bytes in a bundle, from which a new one is begun.
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 8 << 20
#: Fixed values of the seekable format: magic numbers of the skippable frame and of the footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Payloads of fewer bytes are always stored.
LEAST_PAYLOAD = 1000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A WARC/1.1 record. A revisit has the HTTP header, with the full payload's length, and no payload."""
    url = "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Bundle:
    """Frames of records, and where each record is."""

    def __init__(self):
        self.name = uuid.uuid4().hex
        self.frames, self.table, self.index, self.plain, self.size = [], [], [], bytearray(), 0

    def add(self, page_id, raw: bytes) -> None:
        self.index.append({"page_id": page_id, "frame": len(self.frames), "at": len(self.plain), "length": len(raw)})
        self.plain += raw
        if len(self.plain) >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.plain:
            packed = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(bytes(self.plain))
            self.table.append((len(packed), len(self.plain)))
            self.frames.append(packed)
            self.size += len(packed)
            self.plain = bytearray()

    def content(self) -> bytes:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        footer = struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer


def seek_table(content: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of every frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    at, out = 0, []
    for i in range(count):
        begin = len(content) - 9 - (count - i) * width
        packed, plain = struct.unpack("<II", content[begin : begin + 8])
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(content: bytes, where: tuple[int, int, int]) -> bytes:
    at, packed, plain = where
    return zstandard.ZstdDecompressor().decompress(content[at : at + packed], max_output_size=plain)


def parse(raw: bytes) -> dict:
    """Header fields and payload of one record; the digest of a response is computed from what was read."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    name = lambda x: None if x == "null" else int(x)
    page = name(fields["WARC-Record-ID"][len("<urn:page:") : -1])
    stated = fields["WARC-Payload-Digest"][len("sha1:") :]
    if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != stated or len(payload) != length):
        raise ValueError(f"record {page} is damaged")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": page,
        "payload_bytes": length,
        "payload_digest": stated,
        "record_type": fields["WARC-Type"],
        "refers_to": name(refers[len("<urn:page:") : -1]) if refers else None,
        "url": fields["WARC-Target-URI"],
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def plan(pages: DataFrame) -> DataFrame:
    """pages with payload, digest and refers_to: of equal payloads of LEAST_PAYLOAD bytes or more, the largest page_id is stored."""
    payload = C.null_safe_text(F.col("html")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    same = rows.filter(F.octet_length("payload") >= LEAST_PAYLOAD).groupBy("digest").agg(
        F.max("page_id").alias("stored"), F.count("*").alias("n")
    ).filter("n > 1 and stored is not null")
    # one payload may be a third of all rows: its rows are dealt to many tasks
    known = C.spread_join(rows, same.select("digest", "stored"), "digest", by="page_id", how="left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("stored")), F.col("stored")).alias("refers_to")
    return known.select("page_id", "url", "payload", "digest", refers)


BUNDLES = "bundle string, shelf string, content binary, records array<struct<page_id: bigint, frame: int, at: int, length: int>>"
RECORDS = pa.list_(
    pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("at", pa.int32()), ("length", pa.int32())])
)


def write(pages: DataFrame) -> DataFrame:
    """Bundles of all pages, written to the shared folder: bundle, content (the file's bytes), records (its index), shelf.

    Null html: an empty payload. Null url: an empty one. Null page_id: named null, never referred to; with equal payloads
    it revisits the largest id. Rows that repeat the largest id are all responses. Very long html: a frame of its own.
    Empty table: no bundles. Other columns, under any names, are not read.
    """

    def run(batches):
        bundle = Bundle()
        out = lambda: pa.RecordBatch.from_arrays(
            [
                pa.array([bundle.name]),
                pa.array([bundle.name[:2]]),
                pa.array([bundle.content()], pa.binary()),
                pa.array([bundle.index], RECORDS),
            ],
            names=["bundle", "shelf", "content", "records"],
        )
        for batch in batches:
            for row in zip(
                *(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))
            ):
                bundle.add(row[0], record(*row))
                if bundle.size >= BUNDLE_BYTES:
                    yield out()
                    bundle = Bundle()
        if bundle.index:
            yield out()

    return C.materialise(C.small_batches(plan(pages)).mapInArrow(run, BUNDLES), "warc", by="shelf")


def index(bundles: DataFrame) -> DataFrame:
    """page_id -> bundle, frame, offset and length in the frame. No bundles: no rows. Null ids and ids that repeat have a row
    for each record; the length of a payload does not matter."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("bundle", "r.*")


FOUND = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def found_batch(rows: list[dict]) -> pa.RecordBatch:
    types = {
        "page_id": pa.int64(),
        "payload_bytes": pa.int64(),
        "payload_digest": pa.string(),
        "record_type": pa.string(),
        "refers_to": pa.int64(),
        "url": pa.string(),
        "payload": pa.binary(),
    }
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in types.items()], names=list(types))


def read(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, frame by frame; nulls as write() defines them.

    No bundles: no rows. Records that repeat an id: one row each. A very long payload is one frame and read whole.
    """

    def run(batches):
        for batch in batches:
            for content, records in zip(batch.column("content").to_pylist(), batch.column("records").to_pylist()):
                by: dict[int, list[dict]] = {}
                for r in records:
                    by.setdefault(r["frame"], []).append(r)
                for where, own in zip(seek_table(content), (by[k] for k in sorted(by))):
                    plain = read_frame(content, where)
                    yield found_batch([parse(plain[r["at"] : r["at"] + r["length"]]) for r in own])

    return C.small_batches(bundles).select("content", "records").mapInArrow(run, FOUND)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the page_ids in wanted: only frames that hold one are decompressed, and only shelves that hold one
    are read. Ids that no record has, and null ones, give no rows; an id that several records have gives them all."""
    at = index(bundles).join(wanted.select("page_id").distinct(), "page_id").groupBy("bundle").agg(
        F.collect_list(F.struct("page_id", "frame", "at", "length")).alias("records")
    )
    at = C.materialise(at, "wanted")
    shelves = [r[0] for r in at.select(F.substring("bundle", 1, 2)).distinct().collect()]  # 256 at most
    held = bundles.filter(F.col("shelf").isin(shelves)).select("bundle", "content")

    def run(batches):
        for batch in batches:
            for content, records in zip(batch.column("content").to_pylist(), batch.column("records").to_pylist()):
                frames = seek_table(content)
                plain = {k: read_frame(content, frames[k]) for k in {r["frame"] for r in records}}
                yield found_batch([parse(plain[r["frame"]][r["at"] : r["at"] + r["length"]]) for r in records])

    return held.join(at, "bundle").select("content", "records").mapInArrow(run, FOUND)


def contradictions(found: DataFrame) -> DataFrame:
    """Revisits of read() whose digest or length is not that of the response they refer to, or that refer to none."""
    stored = found.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"),
        F.col("payload_digest").alias("digest"),
        F.col("payload_bytes").alias("length"),
    ).distinct()
    both = C.spread_join(
        found.filter("record_type = 'revisit'").drop("payload"),
        stored.groupBy("refers_to").agg(F.collect_set(F.struct("digest", "length")).alias("of")),
        "refers_to",
        by="page_id",
        how="left",
    )
    same = F.exists("of", lambda x: (x["digest"] == F.col("payload_digest")) & (x["length"] == F.col("payload_bytes")))
    return both.filter(~F.coalesce(same, F.lit(False))).drop("of")
