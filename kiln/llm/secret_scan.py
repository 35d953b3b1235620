"""Search for secrets: one automaton finds keywords, anchored expressions look only there, checksums decide.

A text is read as bytes. One Aho-Corasick walk over it in small letters gives the places of all keywords; each kind tries
its expression at its places, from left to right and outside what it has matched, which is what a search of the whole
text would give. Hexadecimal runs have no keyword of their own: with every digit folded to one byte, 32 of these are one.
The kinds beyond the base carry proof inside them, a checksum or a length, and a match that fails its proof is dropped.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import NamedTuple

import ahocorasick
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BASE = ("assign", "access", "hex")
#: Digits of base 62, base 58 and of Bech32.
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = b"123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = b"qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_TERMS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
#: Shortest hexadecimal run.
HEX_RUN = 32
#: Hexadecimal digits as h, all other bytes as a space.
FOLD = bytes(104 if b in b"0123456789abcdef" else 32 for b in range(256))


def crc_token(hit) -> bool:
    """Six base-62 digits at the end are the CRC-32 of the 30 before them."""
    body, check = hit[1][:-6], hit[1][-6:]
    value = 0
    for digit in check:
        value = value * 62 + BASE62.index(digit)
    return value == zlib.crc32(body)


def base58_check(hit) -> bool:
    """The last 4 of 82 bytes are those of the doubled SHA-256 of the others."""
    value = 0
    for digit in hit[0]:
        value = value * 58 + BASE58.index(digit)
    if value.bit_length() > 82 * 8:
        return False
    raw = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def bech32_check(hit) -> bool:
    """The polynomial of prefix and digits leaves one."""
    name, digits = hit[1].lower(), hit[2].lower()
    value = 1
    for x in [*(b >> 5 for b in name), 0, *(b & 31 for b in name), *(BECH32.index(b) for b in digits)]:
        top = value >> 25
        value = (value & 0x1FFFFFF) << 5 ^ x
        for i, term in enumerate(BECH32_TERMS):
            value ^= term if top >> i & 1 else 0
    return value == 1


def padded(part: bytes) -> bytes:
    return part + b"=" * (-len(part) % 4)


def web_token(hit) -> bool:
    """Both leading parts are JSON objects, and the first names its algorithm."""
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(padded(part))) for part in (hit[1], hit[2]))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and isinstance(head.get("alg"), str)


def private_key(hit) -> bool:
    """The DER sequence is as long as it says, or the body has the mark of an OpenSSH key."""
    try:
        raw = base64.b64decode(b"".join(hit[1].split()), validate=True)
    except binascii.Error:
        return False
    if raw.startswith(b"openssh-key-v1\0"):
        return True
    if len(raw) < 2 or raw[0] != 0x30:
        return False
    if raw[1] < 128:
        return len(raw) == 2 + raw[1]
    wide = raw[1] & 127
    return 0 < wide <= 4 and len(raw) == 2 + wide + int.from_bytes(raw[2 : 2 + wide], "big")


class Kind(NamedTuple):
    """Where one of the keywords (small letters) begins, the expression may match; proof says whether a match counts."""

    name: str
    keywords: tuple[str, ...]
    pattern: regex.Pattern
    proof: Callable[[regex.Match], bool]


#: In the order in which spans of one start are listed, hex after access. Each pattern starts with its keyword, and those
#: of variable length that may fail late start at the edge of a word, so that the time grows with the text's length only.
KINDS = (
    Kind(
        "assign",
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        regex.compile(
            rb"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)"
        ),
        lambda hit: len(hit[2]) >= 8,
    ),
    Kind("access", ("akia",), regex.compile(rb"AKIA[A-Z0-9]++"), lambda hit: len(hit[0]) >= 16),
    Kind(
        "github",
        ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
        regex.compile(rb"(?<![A-Za-z0-9])gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
        crc_token,
    ),
    Kind("npm", ("npm_",), regex.compile(rb"(?<![A-Za-z0-9])npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), crc_token),
    Kind("xprv", ("xprv",), regex.compile(rb"(?<![A-Za-z0-9])xprv[%b]{107}(?![A-Za-z0-9])" % BASE58), base58_check),
    Kind(
        "age",
        ("age-secret-key-1",),
        regex.compile(rb"(?<![A-Za-z0-9])(AGE-SECRET-KEY-)1([%b]{58})(?![A-Za-z0-9])" % BECH32.upper()),
        bech32_check,
    ),
    Kind("nsec", ("nsec1",), regex.compile(rb"(?<![A-Za-z0-9])(nsec)1([%b]{58})(?![A-Za-z0-9])" % BECH32), bech32_check),
    Kind(
        "jwt",
        ("eyj",),
        regex.compile(rb"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]++)\.(eyJ[A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++"),
        web_token,
    ),
    Kind(
        "pem",
        ("-----begin ",),
        regex.compile(rb"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----([A-Za-z0-9+/=\s]++)-----END [A-Z ]{0,20}PRIVATE KEY-----"),
        private_key,
    ),
)
RANK = {name: i for i, name in enumerate([*BASE, *(kind.name for kind in KINDS if kind.name not in BASE)])}


def automaton() -> ahocorasick.Automaton:
    """All keywords: each gives its kind and its length. No two kinds share one."""
    out = ahocorasick.Automaton()
    for i, kind in enumerate(KINDS):
        for word in kind.keywords:
            out.add_word(word, (i, len(word)))
    out.make_automaton()
    return out


WORDS = automaton()


def keyword_places(raw: bytes) -> dict[int, list[int]]:
    """For each kind the places where one of its keywords begins, from left to right."""
    out: dict[int, list[int]] = {}
    for at, (i, length) in WORDS.iter(raw.lower().decode("latin-1")):
        out.setdefault(i, []).append(at - length + 1)
    return {i: sorted(places) for i, places in out.items()}


def hex_runs(raw: bytes) -> Iterator[tuple[int, int]]:
    folded, run = raw.translate(FOLD), b"h" * HEX_RUN
    begin = folded.find(run)
    while begin >= 0:
        end = folded.find(b" ", begin)
        end = len(raw) if end < 0 else end
        yield begin, end
        begin = folded.find(run, end)


def byte_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """(begin, end, kind) by begin, then kind, in bytes."""
    found = [(begin, end, "hex") for begin, end in hex_runs(raw)]
    for i, places in keyword_places(raw).items():
        kind, free = KINDS[i], 0
        for place in places:
            hit = kind.pattern.match(raw, place) if place >= free else None
            if hit:
                free = hit.end()
                if kind.proof(hit):
                    found.append((hit.start(), hit.end(), kind.name))
    return sorted(found, key=lambda span: (span[0], RANK[span[2]]))


def code_points(raw: bytes, places: list[int]) -> dict[int, int]:
    """Code points before each place, in one walk."""
    out, before, last = {}, 0, 0
    for place, _ in groupby(sorted(places)):
        before += len(raw[last:place].decode())
        out[place], last = before, place
    return out


def find_secrets(text: str | None) -> list[dict]:
    """Spans of one text in code points, ends exclusive."""
    raw = (text or "").encode()
    found = byte_spans(raw)
    at = code_points(raw, [x for begin, end, _ in found for x in (begin, end)])
    return [{"kind": kind, "begin": at[begin], "end": at[end]} for begin, end, kind in found]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans for every row of df: spans is array<struct<kind, begin, end>> by begin, then in the order of the kinds.

    begin and end count code points, the end exclusive. Base kinds: assign, access, hex. Beyond them: github and npm
    (CRC-32), xprv (doubled SHA-256), age and nsec (Bech32), jwt (JSON parts), pem (DER length). Null or empty text: no
    spans. Null id stays null. Repeated rows: one row each. Very long texts are read whole, in time that grows with their
    length. Empty table: no rows. Other columns are not read, whatever their names.
    """

    def run(batches):
        for batch in batches:
            spans = pa.array([find_secrets(t) for t in batch.column("text").to_pylist()], SPANS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], names=["doc_id", "spans"])

    kind = f"doc_id {dict(df.dtypes)[id_col]}, spans array<struct<kind: string, begin: int, end: int>>"
    return C.small_batches(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kind)


def listed(spans: Column) -> Column:
    """kind:begin:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.begin, s.end)), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s.kind.isin(*BASE))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")


def redacted(df: DataFrame, text_col: str = "text", mark: str = "<{}>") -> DataFrame:
    """df with every secret in its texts replaced by its kind in a mark; spans that overlap become one, named by the first.

    Null text stays null; all other columns and rows stay as they are.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: None if text is None else redact(text, mark))

    return C.small_batches(df).withColumns({text_col: run(F.col(f"`{text_col}`"))})


def redact(text: str, mark: str) -> str:
    out, at = [], 0
    for span in find_secrets(text):
        if span["begin"] >= at:
            out += [text[at : span["begin"]], mark.format(span["kind"])]
        at = max(at, span["end"])
    return "".join([*out, text[at:]])
