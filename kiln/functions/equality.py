"""Whether two answers are equal, tier after tier: one pass over Arrow batches, each pair as cheap as its first tier that decides."""

from __future__ import annotations

import re
from collections.abc import Sequence

from kiln.functions.algebra import expressions_equal, number, read, sides_equal

CLOSE = 1e-4
SHAPED = re.compile(r"[(\[].+[)\]]", re.DOTALL)
MATRIX = re.compile(r"\\begin\{[pb]matrix\}(.*)\\end\{[pb]matrix\}", re.DOTALL)
SET = re.compile(r"\{.*,.*\}")
NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*", re.ASCII)
LITERAL_FRACTION = re.compile(r"-?[0-9]+.?/0*[1-9][0-9]*.?")
TOWER = re.compile(r"\^[0-9]+\^|\^[0-9][0-9]+")


def number_of(text: str) -> float | None:
    """A number without its commas, or a percentage."""
    bare = text.replace(",", "")
    if NUMBER.fullmatch(bare):
        return float(bare)
    if bare.endswith("%"):
        bare = bare[:-1].removesuffix("\\")
        return float(bare) / 100 if NUMBER.fullmatch(bare) else None
    return None


def close(x: float, y: float) -> bool:
    return abs(x - y) <= CLOSE * max(abs(x), abs(y))


def bare(text: str) -> str:
    return re.sub(r"[{}()]", "", text).lower()


def as_vectors(text: str) -> str:
    """Each {a,b,...} as a column vector."""
    made = (m.strip("{}").replace(",", "\\") for m in SET.findall(text.strip()))
    return ", ".join(f"\\begin{{pmatrix}}{m}\\end{{pmatrix}}" for m in made)


def cells(text: str) -> list[list[str]] | None:
    found = MATRIX.fullmatch(text)
    return [line.split("&") for line in found[1].split("\\\\") if line.strip()] if found else None


def all_equal(a: Sequence[str], b: Sequence[str]) -> bool:
    return len(a) == len(b) and all(answers_equal(x, y) for x, y in zip(a, b))


def equations_equal(p: str, r: str) -> bool:
    """Two equations by the difference of their sides; "x = value" against a value."""
    a, b = ([side.strip() for side in x.split("=")] for x in (p, r))
    if len(a) == len(b) == 2:
        return sides_equal(a, b)
    if len(a) == 2 and len(a[0]) <= 2 and len(b) == 1:
        return answers_equal(a[1], r)
    if len(b) == 2 and len(b[0]) <= 2 and len(a) == 1:
        return answers_equal(p, b[1])
    return False


def answers_equal(p: str | None, r: str | None) -> bool:
    """Equal letters, else numbers (final where both are), brackets, tuples, matrices, equations, algebra. Null: False."""
    if p is None or r is None:
        return False
    p, r = p.strip(), r.strip()
    if p.lower() == r.lower():
        return True
    x, y = number_of(p), number_of(r)
    if x is not None and y is not None:
        return close(x, y) or close(x, y / 100) or close(x, y * 100)
    if not p:
        return False
    if "pmatrix" in p and "pmatrix" not in r:
        r = as_vectors(r)
    a, b = p, r
    square = p.startswith("[") and p.endswith("]") and not r.startswith("(")
    if square or (p.startswith("(") and p.endswith(")") and not r.startswith("[")):
        a, b = p.strip("[]()"), r.strip("[]()")
    if bare(a) == bare(b):
        return True
    if SHAPED.match(p) and SHAPED.match(r) and all_equal(p[1:-1].split(","), r[1:-1].split(",")):
        return True
    a, b = cells(p), cells(r)
    if a is not None and b is not None and len(a) == len(b) and all(all_equal(x, y) for x, y in zip(a, b)):
        return True
    return equations_equal(p, r) or expressions_equal(p, r, CLOSE)


def undecided(p: str | None, r: str | None) -> bool:
    """Whether the answers count as different only because one of them cannot be read as an expression."""
    if p is None or r is None or answers_equal(p, r):
        return False
    letters = re.compile(r"[a-zA-Z\\^]")
    return bool(letters.search(p) and letters.search(r)) and any(read(side) is None for x in (p, r) for side in x.split("="))


def forms_equal(p: str | None, r: str | None, a: Sequence, b: Sequence) -> bool:
    """answers_equal, or that of deep forms, of interval ends, or of chain terms, or close values of deep forms.

    a, b: (deep form, [interval ends], closed ends as text, [chain terms], operators as text) of each side.
    """
    if p is None or r is None:
        return False
    (deep, ends, closed, terms, signs), (deep_, ends_, closed_, terms_, signs_) = a, b
    if answers_equal(p, r) or answers_equal(deep[0], deep_[0]):
        return True
    if closed[0] and closed == closed_ and all_equal(ends, ends_):
        return True
    if signs[0] and signs == signs_ and all_equal(terms, terms_):
        return True
    x, y = (number(e) if (e := read(d[0] or "")) else None for d in (deep, deep_))
    return x is not None and y is not None and abs(x - y) < 1e-6 * max(1, abs(y))


def may_evaluate(text: str) -> bool:
    letters = {c for c in text.replace("sqrt", "").replace("frac", "") if c.isalpha()}
    return len(letters) <= 2 and "^{" not in text and "^(" not in text and not TOWER.search(text)


def whole(text: str) -> bool:
    x = number_of(text)
    return x is not None and "%" not in text and x - x == 0 and abs(x - round(x)) <= 1e-7


def elements_equal(truth: str, given: str, a: Sequence[str], b: Sequence[str]) -> bool:
    """Grade forms that are equal, or whose elements are: fractions literally, whole numbers only with whole numbers,
    all others by algebra where they are plain enough. Kinds of brackets do not matter."""
    if truth == given:
        return True
    if not given or not truth or len(a) != len(b) or not a:
        return False
    for x, y in zip(a, b):
        if LITERAL_FRACTION.fullmatch(x) and LITERAL_FRACTION.fullmatch(y):
            equal = x == y
        elif whole(x) != whole(y):
            equal = False
        else:
            equal = may_evaluate(f"({x})-({y})") and expressions_equal(x, y)
        if not equal:
            return False
    return True
