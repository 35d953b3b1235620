"""MPEG audio columns: frame headers found again after damage, tags, variable-bitrate tables, checksums, durations, seek offsets.

pack() lays bytes into a valid MPEG-1 Layer III stream (mono, 48 kHz, variable bitrate, checksums): each frame carries
UNIT of them as ancillary data, and the tag holds their number and digest, since a frame's checksum covers its side
information only. parse() reads any Layer III stream, and any other bytes, and gives such bytes back.
"""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

UNIT = 576
#: Fixed values of MPEG audio: kbit/s by index for Layer III of version 1 and of versions 2 and 2.5, Hz by version and index.
KBITS_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBITS_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
HERTZ = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
#: Every so many frames one has the higher bitrate.
HIGHER = 8


def header_info(head: bytes) -> tuple[int, int, int, int, bool] | None:
    """(frame bytes, samples, Hz, side bytes, has checksum) of a Layer III header; None if it is none."""
    if len(head) < 4 or head[0] != 255 or head[1] & 0xE0 != 0xE0:
        return None
    version, layer, free = head[1] >> 3 & 3, head[1] >> 1 & 3, head[1] & 1
    rate, hertz = head[2] >> 4, head[2] >> 2 & 3
    if version == 1 or layer != 1 or rate in (0, 15) or hertz == 3 or head[3] & 3 == 2:
        return None
    new, mono = version == 3, head[3] >> 6 == 3
    frequency = HERTZ[version][hertz]
    samples = 1152 if new else 576
    size = samples // 8 * (KBITS_1 if new else KBITS_2)[rate] * 1000 // frequency + (head[2] >> 1 & 1)
    return size, samples, frequency, (17 if mono else 32) if new else (9 if mono else 17), not free


def crc16(raw: bytes) -> int:
    """Checksum of a frame: polynomial 0x8005, all ones at first."""
    crc = 0xFFFF
    for byte in raw:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def frame_start(rate_index: int) -> tuple[bytes, int]:
    """Header, checksum and empty side information of a mono frame, and the frame's size."""
    head = bytes((0xFF, 0xFA, rate_index << 4 | 1 << 2, 0xC0))
    size, _, _, side, _ = header_info(head)
    return head + struct.pack(">H", crc16(head[2:] + bytes(side))) + bytes(side), size


LOW, HIGH = frame_start(12), frame_start(13)
FILL = {start: bytes(size - len(start) - UNIT) for start, size in (LOW, HIGH)}


def synchsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def tag(fields: dict[str, str]) -> bytes:
    """An ID3v2.3 tag of user-defined text frames."""
    frames = b""
    for name, value in fields.items():
        text = b"\0" + name.encode("latin-1") + b"\0" + value.encode("latin-1")
        frames += b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\x03\0\0" + synchsafe(len(frames)) + frames


def padded(raw: bytes) -> bytes:
    """raw with bytes 255 up to a positive multiple of UNIT."""
    return raw + b"\xff" * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def pack(payload: bytes, n_bytes: int) -> bytes:
    """A stream: ID3 tag, a frame with the variable-bitrate table, then a frame for each UNIT of payload."""
    count = len(payload) // UNIT
    starts = [HIGH if i % HIGHER == HIGHER - 1 else LOW for i in range(count)]
    total = sum(size for _, size in starts)
    ends, at = [], 0
    for _, size in starts:
        ends.append(at)
        at += size
    toc = bytes(min(255, 256 * ends[count * i // 100] // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", 7, count, total + LOW[1]) + toc
    parts = [
        tag({"n_bytes": str(n_bytes), "sha256": hashlib.sha256(payload).hexdigest()}),
        LOW[0],
        table,
        bytes(LOW[1] - len(LOW[0]) - len(table)),
    ]
    for i, (start, _) in enumerate(starts):
        parts += (start, payload[i * UNIT : i * UNIT + UNIT], FILL[start])
    return b"".join(parts)


CHECKED: dict[bytes, bool] = {}


#: Fixed values of ID3v2: text encodings by their number, and ID3v1's fields by their bounds in its 128 bytes.
ENCODINGS = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
VERSION_1 = {"TIT2": (3, 33), "TPE1": (33, 63), "TALB": (63, 93), "TYER": (93, 97)}


def number(raw: bytes, bits: int = 8) -> int:
    return sum((b & (1 << bits) - 1) << bits * i for i, b in enumerate(reversed(raw)))


def text_fields(name: str, body: bytes) -> dict[str, str]:
    """Of a text frame: its name, or a user-defined one's own name, and its text. Bytes that are no text are replaced."""
    if not body:
        return {}
    words = body[1:].decode(ENCODINGS.get(body[0], "latin-1"), "replace").replace("\ufeff", "").split("\0")
    if name == "TXXX":
        return {words[0]: words[1] if len(words) > 1 else ""}
    return {name: words[0]}


def id3(stream: bytes) -> tuple[int, dict[str, str]]:
    """Length of the ID3v2 tag at the start (0: none), and its text fields. Versions 2.2 to 2.4."""
    if stream[:3] != b"ID3" or len(stream) < 10 or max(stream[6:10]) > 127:
        return 0, {}
    version, flags, size = stream[3], stream[5], number(stream[6:10], 7)
    length = 10 + size + (10 if version == 4 and flags & 0x10 else 0)
    body = stream[10 : 10 + size]
    if flags & 0x80 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at, fields = 0, {}
    if flags & 0x40 and version >= 3:  # extended header: 2.4 counts its own size, 2.3 does not
        at = number(body[:4], 7) if version == 4 else 4 + number(body[:4])
    wide, long = (6, 3) if version == 2 else (10, 4)
    while at + wide <= len(body) and body[at : at + long].isalnum():
        n = number(body[at + long : at + 2 * long], 7 if version == 4 else 8)
        raw = body[at + wide : at + wide + n]
        if version == 4 and body[at + 9] & 3:  # a data length, then bytes that may be unsynchronised
            raw = raw[4:] if body[at + 9] & 1 else raw
            raw = raw.replace(b"\xff\0", b"\xff") if body[at + 9] & 2 else raw
        if body[at : at + 1] == b"T":
            fields |= text_fields(body[at : at + long].decode("ascii"), raw)
        at += wide + n
    return length, fields


def rate_table(frame: bytes, data: int) -> dict | None:
    """The variable-bitrate table of a first frame: frames, bytes, toc (null where not stated), encoder delay and padding.

    Xing and Info tables stand behind the side information (data), VBRI tables 36 bytes into the frame.
    """
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        delay, total, frames, entries, _, width = (
            number(frame[i:j]) for i, j in ((42, 44), (46, 50), (50, 54), (54, 56), (56, 58), (58, 60))
        )
        return {"frames": frames, "bytes": total, "toc": frame[62 : 62 + entries * width], "delay": delay, "padding": 0}
    if frame[data : data + 4] not in (b"Xing", b"Info"):
        return None
    flags, at, out = number(frame[data + 4 : data + 8]), data + 8, {
        "frames": None, "bytes": None, "toc": None, "delay": 0, "padding": 0
    }
    for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, None, 4)):
        if flags & bit:
            raw = frame[at : at + n]
            if name and len(raw) == n:
                out[name] = raw if name == "toc" else number(raw)
            at += n
    if frame[at : at + 4] in (b"LAME", b"Lavc", b"Lavf") and len(frame) >= at + 24:
        gap = number(frame[at + 21 : at + 24])
        out |= {"delay": gap >> 12, "padding": gap & 4095}
    return out


def parse(stream: bytes) -> dict:
    """What a Layer III stream holds: frames, samples, rate, seek offsets, tag, table, bytes skipped, failed checksums, payload.

    Out of step, a header counts if the frame it states ends at another header or at the stream's end; else the search
    goes on at the next byte 255. A frame with a failed checksum is counted and its payload left out. The frame of a
    table is none of the audio; samples and seconds are without the encoder's delay and padding, where the table states
    them. intact: whether the payload has the digest in the tag (null: the tag has none). Any bytes may be given: empty
    ones, and such without frames, have no frames, 0 seconds and an empty payload.
    """
    at, fields = id3(stream)
    end, offsets, skipped, failed, samples, hertz, table, parts = len(stream), [], 0, 0, 0, 0, None, []
    if stream[-128:-125] == b"TAG" and len(stream) >= at + 128:
        end -= 128
        last = stream[end:]
        old = {name: last[i:j].split(b"\0")[0].decode("latin-1").strip() for name, (i, j) in VERSION_1.items()}
        fields = {name: value for name, value in old.items() if value} | fields
    first, synced = True, False
    while at + 4 <= end:
        info = header_info(stream[at : at + 4]) if stream[at] == 255 else None
        behind = at + info[0] if info else 0
        if not info or behind > end or not synced and behind + 4 <= end and not header_info(
            stream[behind : behind + 4]
        ):
            following = stream.find(b"\xff", at + 1, end)
            following = end if following < 0 else following
            skipped += following - at
            at, synced = following, False
            continue
        _, n, rate, side, protected = info
        body = at + 4 + 2 * protected
        ok = True
        if protected:
            key = stream[at + 2 : body + side]
            ok = CHECKED.get(key)
            if ok is None:
                ok = number(key[2:4]) == crc16(key[:2] + key[4:])
                if len(CHECKED) < 10_000:
                    CHECKED[key] = ok
        data = body + side
        found = rate_table(stream[at:behind], data - at) if first else None
        if found:
            table = found
        else:
            offsets.append(at)
            samples += n
            hertz = rate
            failed += not ok
            if ok:
                parts.append(stream[data : min(data + UNIT, behind)])
        first, synced = False, True
        at = behind
    if table:
        samples = max(0, samples - table["delay"] - table["padding"])
    payload = b"".join(parts)
    intact = hashlib.sha256(payload).hexdigest() == fields["sha256"] if "sha256" in fields else None
    out = {
        "frames": len(offsets),
        "samples": samples,
        "hertz": hertz,
        "seconds": samples / hertz if hertz else 0.0,
        "offsets": offsets,
        "fields": fields,
    }
    return out | {
        "table": table,
        "skipped": skipped + max(0, end - max(at, 0)),
        "failed": failed,
        "payload": payload,
        "intact": intact,
    }


def to_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each whole text, however long, as an MPEG audio stream. Null text: as an empty one.

    Null id: stays null. Repeated rows: one row each; equal texts have equal streams. Empty table: no rows. Other columns
    are not read.
    """

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([pack(padded(r), len(r)) for r in raw], pa.binary())],
                    names=["doc_id", "media"],
                )

    return C.small_batches(df).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(run, f"doc_id {dict(df.dtypes)[id_col]}, media binary")


FOUND = {
    "frames": pa.int64(),
    "samples": pa.int64(),
    "hertz": pa.int64(),
    "seconds": pa.float64(),
    "offsets": pa.list_(pa.int64()),
    "table_frames": pa.int64(),
    "toc": pa.binary(),
    "skipped": pa.int64(),
    "failed": pa.int64(),
    "n_bytes": pa.int64(),
    "intact": pa.bool_(),
    "payload": pa.binary(),
}


def probe(df: DataFrame) -> DataFrame:
    """(doc_id, media) with what parse() finds: exact durations, byte offset of every frame, table, damage, payload.

    Null or empty media, and media without frames: no frames, 0 seconds, an empty payload. n_bytes: from the tag, else null.
    Repeated rows: one row each. Empty table: no rows.
    """

    def run(batches):
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                found = [parse(m or b"") for m in part.column("media").to_pylist()]
                for f in found:
                    f |= {
                        "n_bytes": int(f["fields"]["n_bytes"]) if f["fields"].get("n_bytes", "").isdecimal() else None,
                        "table_frames": f["table"]["frames"] if f["table"] else None,
                        "toc": f["table"]["toc"] if f["table"] else None,
                    }
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        part.column("media"),
                        *(pa.array([f[k] for f in found], t) for k, t in FOUND.items()),
                    ],
                    names=["doc_id", "media", *FOUND],
                )

    kind = "frames long, samples long, hertz long, seconds double, offsets array<bigint>, table_frames long, toc binary, skipped long, failed long, n_bytes long, intact boolean, payload binary"
    return C.small_batches(df).select("doc_id", "media").mapInArrow(
        run, f"doc_id {dict(df.dtypes)['doc_id']}, media binary, {kind}"
    )
