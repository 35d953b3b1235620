"""Fuzzy search for short licence notices: exact seeds by pigeonhole, then bounded-error matching by the regex library.

A notice with at most e edits in it has one of its e + 1 pieces unchanged. One automaton finds the pieces of all notices
in one walk; those that occur give candidate places, windows around them are joined where they overlap, and each is
matched with a bounded number of errors, which gives the spans and the edits.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .notices import notices

#: Phrases of the base and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Bytes that part words become spaces, capital letters small ones: words are what is left.
FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def seeds(phrase: bytes, edits: int) -> list[tuple[int, bytes]]:
    """Offsets and texts of edits + 1 pieces of nearly equal length."""
    cut = [len(phrase) * i // (edits + 1) for i in range(edits + 2)]
    return [(i, phrase[i:j]) for i, j in zip(cut, cut[1:])]


class Notice:
    def __init__(self, phrase: str, label: str, edits: int):
        self.phrase, self.label, self.edits = phrase.encode(), label, edits
        self.seeds = seeds(self.phrase, edits)
        self.match = regex.compile(
            b"(?e)\\b(?:" + regex.escape(self.phrase, special_only=True) + b"){e<=%d}(?![0-9a-z])" % edits
        )

    def spans(self, line: bytes, places: list[int]) -> list[tuple[int, int, int]]:
        """(begin, end, edits) of the notice in the windows around the places, from left to right, without overlaps."""
        found, slack = [], self.edits + 2
        windows: list[list[int]] = []
        for place in sorted(places):
            begin, end = max(0, place - slack), place + len(self.phrase) + slack + 1
            if windows and begin <= windows[-1][1]:
                windows[-1][1] = max(end, windows[-1][1])
            else:
                windows.append([begin, end])
        for begin, end in windows:
            for hit in self.match.finditer(line[max(0, begin - 1) : end]):
                at = hit.start() + max(0, begin - 1)
                found.append((at, at + len(hit[0]), sum(hit.fuzzy_counts)))
        return found


SEARCHES = [Notice(*notice) for notice in notices()]


def automaton() -> ahocorasick.Automaton:
    """All notices' pieces: a piece gives the (notice, offset of its last byte) that have it."""
    pieces: dict[str, list[tuple[int, int]]] = {}
    for i, notice in enumerate(SEARCHES):
        for offset, piece in notice.seeds:
            pieces.setdefault(piece.decode(), []).append((i, offset + len(piece) - 1))
    out = ahocorasick.Automaton()
    for piece, owners in pieces.items():
        out.add_word(piece, owners)
    out.make_automaton()
    return out


PIECES = automaton()


def candidate_places(line: bytes) -> dict[int, list[int]]:
    """For each notice of which a piece occurs, where it would begin."""
    out: dict[int, list[int]] = {}
    for at, owners in PIECES.iter(line.decode("latin-1")):
        for i, offset in owners:
            out.setdefault(i, []).append(at - offset)
    return out


def base_places(line: bytes) -> list[tuple[int, str]]:
    """First word (from 0) and label of every place where a phrase's words stand consecutively. line: words, each between two spaces."""
    found = []
    for phrase, label in BASE.items():
        needle = b" %s " % phrase.encode()
        at = line.find(needle)
        while at >= 0:
            found.append((at, label))
            at = line.find(needle, at + 1)
    if not found:
        return []
    spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    return list(zip(np.searchsorted(spaces, [at for at, _ in found]).tolist(), [label for _, label in found]))


def scan_text(text: str | None) -> dict:
    words = (text or "").encode().translate(FOLD).split()
    line = b" " + b" ".join(words) + b" "
    base, spans = base_places(line), []
    for i, places in candidate_places(line).items():
        notice = SEARCHES[i]
        for begin, end, edits in notice.spans(line, places):
            spans.append(
                {
                    "label": notice.label,
                    "begin": begin - 1,
                    "end": end - 1,
                    "edits": edits,
                    "score": 1 - edits / len(notice.phrase),
                }
            )
    spans.sort(key=lambda s: (s["begin"], s["end"], s["label"]))
    own = sorted({label for _, label in base})
    return {
        "n_words": len(words),
        "n_base": len(base),
        "first_word": min((i for i, _ in base), default=None),
        "last_word": max((i for i, _ in base), default=None),
        "base_labels": ",".join(own),
        "labels": ",".join(sorted({*own, *(s["label"] for s in spans)})),
        "score": 1.0 if base else max((s["score"] for s in spans), default=0.0),
        "spans": spans,
    }


TYPES = {
    "n_words": pa.int64(),
    "n_base": pa.int64(),
    "first_word": pa.int64(),
    "last_word": pa.int64(),
    "base_labels": pa.string(),
    "labels": pa.string(),
    "score": pa.float64(),
    "spans": pa.list_(
        pa.struct(
            [
                ("label", pa.string()),
                ("begin", pa.int32()),
                ("end", pa.int32()),
                ("edits", pa.int32()),
                ("score", pa.float64()),
            ]
        )
    ),
}


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for every row of df, whole texts.

    spans: label, edits, score, and byte offsets in the words of the text, lower-cased and joined by one space. score: 1
    with a base place, else the best notice's share of unchanged letters, else 0. Null or empty text: no words, empty
    labels, score 0. Long texts are read whole, in time that grows with their length. Repeated rows: one row each. Null id stays null. Empty table: no rows. Other columns are not read.
    """

    def run(batches):
        for batch in batches:
            found = [scan_text(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([f[k] for f in found], t) for k, t in TYPES.items())],
                names=["doc_id", *TYPES],
            )

    kind = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, begin: int, end: int, edits: int, score: double>>"
    return C.small_batches(df).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")
    ).mapInArrow(run, f"doc_id {dict(df.dtypes)[id_col]}, {kind}")
