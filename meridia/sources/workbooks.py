"""Rows of Excel workbooks (.xlsx): the XML parts of the archive are read as streams, one row at a time.

Only the sheets that are asked for are opened. Shared strings are held, as any cell may name one. Numbers come out as
text without a needless fraction, dates (told by their cells' formats) as yyyy-MM-dd, with a time where there is one.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: The built-in number formats that show a date or a time.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


def _ended(archive: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """The elements of a tag as they end; what was read is let go of."""
    if name not in archive.namelist():
        return
    with archive.open(name) as part:
        parents: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(part, events=("start", "end")):
            if event == "start":
                parents.append(e)
                continue
            parents.pop()
            if e.tag == MAIN + tag or e.tag.rsplit("}", 1)[-1] == tag:
                yield e
                e.clear()
                if parents:
                    parents[-1].remove(e)


def _text(e: ElementTree.Element) -> str:
    """All runs of a string, without the readings that may stand beside it."""
    return "".join(t.text or "" for child in e if child.tag != MAIN + "rPh" for t in child.iter(MAIN + "t"))


def _is_date(code: str) -> bool:
    return bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.IGNORECASE)) and code.lower() != "general"


class Workbook:
    def __init__(self, content: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(content))
        targets = {e.get("Id"): e.get("Target") for e in _ended(self.archive, "xl/_rels/workbook.xml.rels", "Relationship")}
        self.sheets: dict[str, str] = {}
        self.epoch = dt.datetime(1899, 12, 30)
        for e in ElementTree.fromstring(self.archive.read("xl/workbook.xml")).iter():
            if e.tag == MAIN + "sheet":
                target = targets[e.get(_REL_ID)]
                self.sheets[e.get("name")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            elif e.tag == MAIN + "workbookPr" and e.get("date1904") in ("1", "true"):
                self.epoch = dt.datetime(1904, 1, 1)
        self._strings: list[str] | None = None
        self._dates: list[bool] | None = None

    def strings(self) -> list[str]:
        if self._strings is None:
            self._strings = [_text_of_item(e) for e in _ended(self.archive, "xl/sharedStrings.xml", "si")]
        return self._strings

    def dates(self) -> list[bool]:
        """Whether each cell format shows a date."""
        if self._dates is None:
            self._dates = []
            if "xl/styles.xml" in self.archive.namelist():
                root = ElementTree.fromstring(self.archive.read("xl/styles.xml"))
                own = {int(e.get("numFmtId")): _is_date(e.get("formatCode", "")) for e in root.iter(MAIN + "numFmt")}
                for e in root.findall(f"{MAIN}cellXfs/{MAIN}xf"):
                    n = int(e.get("numFmtId", 0))
                    self._dates.append(own.get(n, n in DATE_FORMATS))
        return self._dates

    def value(self, cell: ElementTree.Element) -> str | None:
        kind, v = cell.get("t", "n"), cell.find(MAIN + "v")
        if kind == "inlineStr":
            own = cell.find(MAIN + "is")
            return None if own is None else _text_of_item(own)
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings()[int(v.text)]
        if kind == "b":
            return "TRUE" if v.text == "1" else "FALSE"
        if kind != "n":  # a formula's text, an error, an ISO date
            return v.text
        number = float(v.text)
        style = int(cell.get("s", 0))
        if style < len(self.dates()) and self.dates()[style]:
            at = self.epoch + dt.timedelta(seconds=round(number * 86400))
            return str(at.date()) if at.time() == dt.time() else at.strftime("%Y-%m-%d %H:%M:%S")
        return str(int(number)) if number.is_integer() and abs(number) < 1e15 else repr(number)

    def rows(self, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
        """(number from 0, cells) of the rows that are there; cells that are not are null."""
        at = -1
        for row in _ended(self.archive, self.sheets[sheet], "row"):
            at = int(row.get("r")) - 1 if row.get("r") else at + 1
            cells: list[str | None] = []
            for cell in row.findall(MAIN + "c"):
                place = _column(cell.get("r")) if cell.get("r") else len(cells)
                cells += [None] * (place - len(cells))
                cells.append(self.value(cell))
            yield at, cells


def _text_of_item(e: ElementTree.Element) -> str:
    """The text of a shared or inline string: its own, or that of its runs."""
    own = e.find(MAIN + "t")
    return (own.text or "") if own is not None else _text(e)


def _column(reference: str) -> int:
    n = 0
    for letter in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(letter) - 64
    return n - 1
