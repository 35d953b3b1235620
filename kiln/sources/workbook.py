"""Rows of a workbook's first sheet, streamed."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

SPACE = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def first_sheet(book: zipfile.ZipFile) -> str:
    return min(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))


def words(e: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in e.iter(f"{SPACE}t"))


def elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """Elements of a part one after another; each is forgotten when the next one is asked for."""
    with book.open(name) as part:
        parents: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(part, events=("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag == SPACE + tag:
                yield e
                if parents:
                    parents[-1].clear()


def sheet_rows(file, start: int = 0, stop: int | None = None) -> Iterator[list[str]]:
    """Rows from start up to stop: stripped texts, empty ones where cells are absent."""
    with zipfile.ZipFile(file) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [words(e) for e in elements(book, "xl/sharedStrings.xml", "si")]
        for number, row in enumerate(elements(book, first_sheet(book), "row")):
            if stop is not None and number >= stop:
                return
            if number >= start:
                yield cells_of(row, shared)


def cells_of(row: ElementTree.Element, shared: list[str]) -> list[str]:
    own: dict[int, str] = {}
    for c in row.iter(f"{SPACE}c"):
        letters = re.match("[A-Z]*", c.get("r", "")).group()
        at = reduce(lambda n, x: n * 26 + ord(x) - 64, letters, 0) - 1 if letters else len(own)
        value = c.find(f"{SPACE}v")
        text = words(c) if c.get("t") == "inlineStr" else "" if value is None else value.text or ""
        own[at] = (shared[int(text)] if c.get("t") == "s" and text else text).strip()
    return [own.get(i, "") for i in range(max(own, default=-1) + 1)]
