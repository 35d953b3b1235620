"""Byte-pair encoding and decoding by prefix-sharing trie traversal.

The encoding of a word's prefix ends with some token t, and what stands before t is the encoding of the prefix that is
shorter by t. So one state for each prefix is enough: its last token. It is the token that ends the prefix and that may
follow the last token u of the shorter prefix, which holds when the bytes of u and t together encode as u, t; exactly
one token does. Each batch's distinct words go into a trie, which is walked depth first: a prefix that many words share
gets its state once. A word's encoding is read off by going back token by token.
"""

from __future__ import annotations

import array
import hashlib
import json
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Fixed value: the pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose encodings a worker keeps between batches.
KEPT_WORDS = 250_000
#: Pairs of tokens known to stand behind one another that a worker keeps between tasks.
KEPT_PAIRS = 300_000
END = -1


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens, merges and special tokens of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {
            i: raw(t) for t, i in spec["model"]["vocab"].items() if t not in self.special
        } | {i: t.encode() for t, i in self.special.items()}
        self.id_of = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.rank = {}
        for n, pair in enumerate(spec["model"]["merges"]):
            a, b = map(raw, pair if isinstance(pair, list) else pair.split(" "))
            self.rank[self.id_of[a], self.id_of[b]] = (n, self.id_of[a + b])
        sizes: dict[bytes, set[int]] = {}  # by the last three bytes: token lengths, long to short
        for token in self.id_of:
            if len(token) > 2:
                sizes.setdefault(token[-3:], set()).add(len(token))
        self.sizes = {k: (*sorted(v, reverse=True), 2, 1) for k, v in sizes.items()}
        self.size_of = {i: len(t) for i, t in self.bytes_of.items()}
        self.words = regex.compile(PATTERN)
        marks = "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))
        self.splitter = regex.compile(f"({marks})") if self.special else None
        self.fits: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}

    def merged(self, raw: bytes) -> list[int]:
        """Plain BPE, for the short byte strings of two tokens."""
        ids = [self.id_of[raw[i : i + 1]] for i in range(len(raw))]
        while True:
            best = min(((self.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                return ids
            (n, new), _ = best
            out, i = [], 0
            while i < len(ids):
                if i + 1 < len(ids) and self.rank.get((ids[i], ids[i + 1])) == (n, new):
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out

    def follows(self, u: int, t: int) -> bool:
        """Whether token t may stand behind token u; u is END at a word's start."""
        key = (u + 1) << 32 | t
        found = self.fits.get(key)
        if found is None:
            raw = self.bytes_of[t]
            found = self.merged(raw) == [t] if u == END else self.merged(self.bytes_of[u] + raw) == [u, t]
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = found
        return found

    def extend(self, word: bytes, begin: int, last: list[int]) -> None:
        """Sets last[d], the state of the prefix of d bytes, for d from begin + 1 to the word's length."""
        sizes, id_of, fits, follows = self.sizes, self.id_of, self.fits, self.follows
        for depth in range(begin + 1, len(word) + 1):
            for size in sizes.get(word[depth - 3 : depth], (2, 1)) if depth > 2 else (2, 1):
                if size <= depth:
                    t = id_of.get(word[depth - size : depth])
                    if t is not None:
                        u = last[depth - size]
                        ok = fits.get((u + 1) << 32 | t)
                        if follows(u, t) if ok is None else ok:
                            last[depth] = t
                            break

    def read_back(self, depth: int, last: list[int]) -> bytes:
        ids, size_of = [], self.size_of
        while depth:
            t = last[depth]
            ids.append(t)
            depth -= size_of[t]
        ids.reverse()
        return little_endian(ids)

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Distinct words -> their token ids as little-endian unsigned 32-bit integers.

        The trie is held as the sorted words with the lengths of their common prefixes, so a chain of single children
        takes no nodes. Going through them in order walks it depth first: `last` holds the states from the root to the
        current node, goes back to the branching point, and is extended along the new edge.
        """
        found, before, last = {}, b"", [END]
        for raw, word in sorted((w.encode(), w) for w in words):
            shared, most = 0, min(len(before), len(raw))
            while shared < most and before[shared] == raw[shared]:
                shared += 1
            if len(last) <= len(raw):
                last.extend([END] * (len(raw) + 1 - len(last)))
            self.extend(raw, shared, last)
            found[word] = self.read_back(len(raw), last)
            before = raw
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Token ids of each text, as bytes. A special token's string becomes that token, as in the library."""
        pieces, distinct = [], set()
        for text in texts:
            own = []
            for i, part in enumerate(self.splitter.split(text or "") if self.splitter else [text or ""]):
                own.append((self.special[part], ()) if i % 2 else (None, self.words.findall(part)))
                distinct.update(own[-1][1])
            pieces.append(own)
        new = [w for w in distinct if w not in self.kept]
        if len(self.kept) + len(new) > KEPT_WORDS:
            table = self.encode_words(list(distinct))
            self.kept = {}
        else:
            self.kept.update(self.encode_words(new))
            table = self.kept
        look = table.__getitem__
        out = [
            b"".join(
                chain.from_iterable(
                    (little_endian([special]),) if special is not None else map(look, words) for special, words in own
                )
            )
            for own in pieces
        ]
        if table is not self.kept:
            self.kept = table if len(table) <= KEPT_WORDS else {}
        return out

    def rest(self) -> None:
        """Between tasks: gives back what grew with the texts, but for pairs of tokens that most texts need."""
        self.kept.clear()
        if len(self.fits) > KEPT_PAIRS:
            self.fits.clear()

    def decode(self, ids: list[bytes | None]) -> list[str]:
        """Texts of token ids; bytes that are no UTF-8 become U+FFFD. Special tokens are kept. Null: empty."""
        look, out = self.bytes_of.__getitem__, []
        for raw in ids:
            out.append(b"".join(map(look, numbers(raw or b""))).decode("utf-8", "replace"))
        return out


def little_endian(ids: list[int]) -> bytes:
    a = array.array("I", ids)
    if not LITTLE:
        a.byteswap()
    return a.tobytes()


def numbers(raw: bytes) -> array.array:
    a = array.array("I")
    a.frombytes(raw)
    if not LITTLE:
        a.byteswap()
    return a


LITTLE = array.array("I", [1]).tobytes()[0] == 1


def vocabulary(path: str) -> Vocabulary:
    return C.held(("vocabulary", path), lambda: Vocabulary(path))


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, n_tokens) for every row of df, whole texts. path: a byte-level tokenizers JSON, on every executor.

    ids are little-endian unsigned 32-bit integers; id_array() makes an array of them. Null or empty text: no tokens.
    Repeated rows: one row each. Empty table: no rows. Other columns are not read. Words of any length take memory in
    proportion to their length only.
    """

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            ids = v.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                names=["doc_id", "ids", "n_tokens"],
            )

    return C.small_batches(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        C.lean_batches(run, lambda: vocabulary(path).rest(), holds=True),
        f"doc_id {dict(df.dtypes)[id_col]}, ids binary, n_tokens long",
    )


def decode(df: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` to (doc_id, ids, n_tokens): the text of the ids, special tokens kept.

    Null or empty ids: an empty text. Null doc_ids and repeated rows: one row each. Empty table: no rows. Other columns
    are not read.
    """

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(v.decode(batch.column("ids").to_pylist()), pa.string())],
                names=["doc_id", "ids", "n_tokens", "decoded"],
            )

    return df.select("doc_id", "ids", "n_tokens").mapInArrow(
        C.lean_batches(run, holds=True), f"doc_id {dict(df.dtypes)['doc_id']}, ids binary, n_tokens long, decoded string"
    )


def id_array(ids: str = "ids"):
    """Column: the ids as array<bigint>."""
    h = F.hex(F.col(ids))
    return F.when(F.length(F.col(ids)) == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(
            F.sequence(F.lit(0), (F.length(F.col(ids)) / 4).cast("int") - 1),
            lambda i: F.conv(
                F.concat(*[F.substr(h, i * 8 + 1 + 2 * k, F.lit(2)) for k in (3, 2, 1, 0)]), 16, 10
            ).cast("bigint"),
        )
    )


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes whole texts, then decodes what was encoded.

    Both in one worker, which holds one vocabulary. Nulls, repeated rows and empty tables as in encode() and decode().
    """

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            ids = v.encode(batch.column("text").to_pylist())
            shas = [hashlib.sha256(x).hexdigest() for x in ids]
            decoded = [hashlib.sha256(text.encode()).hexdigest() for text in v.decode(ids)]
            sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), sizes, pa.array(shas, pa.string()), pa.array(decoded, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = C.small_batches(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(
        C.lean_batches(run, lambda: vocabulary(path).rest(), holds=True),
        f"doc_id {dict(df.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )
