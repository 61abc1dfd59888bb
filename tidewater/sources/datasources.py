"""Python data sources: worksheets, paged rows."""

from __future__ import annotations

import glob
import io
import json
import re
import urllib.request
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _files(options: dict) -> list[str]:
    out: list[str] = []
    for p in options["path"].split(","):
        p = p.removeprefix("file://")
        out += sorted(glob.glob(p)) or [p]
    return out


# Namespaces of the workbook format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


class WorkbookSource(DataSource):
    """Options ``path`` and ``sheet``. The first row names the cells."""

    @classmethod
    def name(cls) -> str:
        return "tidewater_xlsx"

    def schema(self) -> str:
        return "path string, locator string, cells map<string,string>"

    def reader(self, schema):
        return _Workbook(self.options)


class _Workbook(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [_File(p) for p in _files(self.options)]

    def read(self, part) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            rows = worksheet(f.read(), self.options["sheet"])
        head: dict[str, str] = {}
        for i, cells in rows:
            if not head:
                head = {k: v for k, v in cells.items() if v}
                continue
            yield part.path, f"{self.options['sheet']}:{i}", {name: cells.get(k) for k, name in head.items()}


def worksheet(content: bytes, sheet: str) -> Iterator[tuple[int, dict[str, str]]]:
    """(row number, column letters -> text) of a worksheet; shared and inline texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
        sheets = {s.get("name"): targets[s.get(f"{REL}id")] for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
        if sheet not in sheets:
            raise ValueError(f"no worksheet {sheet}")
        inner = sheets[sheet].lstrip("/")
        for _, row in ElementTree.iterparse(z.open(inner if inner.startswith("xl/") else f"xl/{inner}")):
            if row.tag != f"{MAIN}row":
                continue
            cells = {}
            for c in row.iter(f"{MAIN}c"):
                v = c.find(f"{MAIN}v")
                if c.get("t") == "s" and v is not None:
                    text = shared[int(v.text)]
                elif c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                else:
                    text = v.text if v is not None else None
                if text is not None:
                    cells[re.match("[A-Z]+", c.get("r")).group()] = text
            yield int(row.get("r")), cells
            row.clear()


class _Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


class PagedSource(DataSource):
    """Rows of a service that gives them by offset and length. Options ``url`` (with ``{offset}``
    and ``{length}``), ``rows`` (how many are wanted) and ``page`` (at most this many at once).
    Pages are independent tasks; a page beyond the end is empty."""

    @classmethod
    def name(cls) -> str:
        return "tidewater_pages"

    def schema(self) -> str:
        return "locator bigint, value string"

    def reader(self, schema):
        return _Pages(self.options)


class _Pages(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        want, page = int(self.options["rows"]), int(self.options.get("page", 100))
        return [_Page(i, min(page, want - i)) for i in range(0, want, page)]

    def read(self, part) -> Iterator[tuple]:
        with urllib.request.urlopen(self.options["url"].format(offset=part.offset, length=part.length), timeout=60) as r:
            rows = json.load(r).get("rows", [])
        for i, row in enumerate(rows[: part.length]):
            yield part.offset + i, json.dumps(row, ensure_ascii=False, sort_keys=True)
