"""Fill-in-the-middle training texts: a text is cut at two unit ends and its middle goes last, behind sentinels.

One Arrow-batched pandas UDF does it all: the regex library walks a text once and its unit ends go to a compact array,
two look-ups in that array give the cuts, and hashlib gives the draws (from the id alone, so reruns and lost tasks agree)
and the digests. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Code points.
UNIT = r"."
#: Units that one match of the walk covers; their ends are its captures.
STRIDE = 1024
KIND = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def checked(sentinels: Sequence[str]) -> tuple[str, str, str]:
    """Sentinels that can be found again in any output: none is part of another or ends as one begins."""
    p, s, m = sentinels
    for i, a in enumerate((p, s, m)):
        for j, b in enumerate((p, s, m)):
            if not a or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) or (i != j and a in b):
                raise ValueError(f"sentinels {a!r} and {b!r} may be confused in an output")
    return p, s, m


class Units:
    """The ends of a text's units, matched left to right. What lies between two units belongs to the later one."""

    def __init__(self, unit: str = UNIT):
        if regex.compile(unit, regex.DOTALL).fullmatch(""):
            raise ValueError("a unit must not be empty")
        self.walk = regex.compile(f"({unit}){{1,{STRIDE}}}", regex.DOTALL)

    def ends(self, text: str) -> array:
        out = array("I")
        for run in self.walk.finditer(text):
            out.extend(run.ends(1))
        return out


class Rates(NamedTuple):
    """Of 100 texts so many are rearranged, and of 100 of these so many have the suffix first."""

    rearranged: int = 90
    suffix_first: int = 20


def draws(doc_id: str, epoch: int) -> list[int]:
    digest = hashlib.sha256(f"{epoch}:{doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def rearrange(
    text: str, doc_id: str, units: Units, rates: Rates, epoch: int, marks: tuple[str, str, str]
) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, output."""
    ends = units.ends(text)
    n, (h1, h2, h3, h4) = len(ends), draws(doc_id, epoch)
    if not text or h3 % 100 >= rates.rearranged or any(mark in text for mark in marks):
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    i, j = (ends[k - 1] if k else 0 for k in (first, second))
    p, s, m = marks
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if h4 % 100 < rates.suffix_first:
        return n, "spm", i, j - i, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", i, j - i, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(output: str, form: str, marks: tuple[str, str, str] = SENTINELS) -> str:
    """The text from which rearrange() made the output."""
    if form == "plain":
        return output
    p, s, m = marks
    one, two = (p, s) if form == "psm" else (s, p)
    begin, turn = len(one), output.index(two, len(one))
    last = output.index(m, turn + len(two))
    ahead, behind, middle = output[begin:turn], output[turn + len(two) : last], output[last + len(m) :]
    return ahead + middle + behind if form == "psm" else behind + middle + ahead


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def restored(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The texts from which transform() made the outputs. Nulls stay null."""
    marks = checked(sentinels)

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        both = zip(outputs, forms)
        return pd.Series([None if o is None or f is None else restore(o, f, marks) for o, f in both], dtype=object)

    return run(output, form)


def transform(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = UNIT,
    rates: Rates = Rates(),
    epoch: int = 1,
    sentinels: Sequence[str] = SENTINELS,
    keep_text: bool = True,
) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output_sha256, restored_sha256 and, if
    keep_text, output for every row of df.

    unit: a pattern of the regex library; code points by default, r"\\X" for graphemes, r"\\S+\\s*" for words. The draws
    come from the sha256 of epoch, a colon and the id. A text that has a sentinel stays plain. Null or empty text: empty,
    plain, no units. Null id: drawn as an empty id, and it stays null. Repeated rows: one equal row each. Very long texts
    are cut whole, four bytes a unit beside them. Empty table: no rows. Other columns are not read, whatever their names.
    """
    units, marks, kind = Units(unit), checked(sentinels), KIND + (", output string" if keep_text else "")

    @F.pandas_udf(kind)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for doc_id, text in zip(ids, texts):
            n, form, prefix, middle, output = rearrange(text, doc_id, units, rates, epoch, marks)
            row = (n, form, prefix, middle, sha256(output), sha256(restore(output, form, marks)))
            rows.append((*row, output) if keep_text else row)
        out = pd.DataFrame(rows, columns=[part.split()[0] for part in kind.split(", ")], dtype=object)
        return out.astype({"n": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    made = run(F.coalesce(F.col(id_col).cast("string"), F.lit("")), C.null_safe_text(F.col(text_col)))
    return C.small_batches(df).select(F.col(id_col).alias("doc_id"), made.alias("made")).select("doc_id", "made.*")
