"""Data source `xlsx_wide`: a sheet of an Office Open XML workbook as text columns, read with the standard library.

The first row holds the column names; columns without a name and rows without any value are skipped. Options: path, sheet (name;
the first by default). One file is one partition; a folder is read file by file in parallel.
"""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

# Namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"


def _column(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", reference).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def _number_text(raw: str) -> str:
    try:
        value = float(raw)
    except ValueError:
        return raw
    return str(int(value)) if value.is_integer() else raw


def rows_of(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """All rows of a sheet as texts; whole numbers without decimals, booleans as true and false."""
    with zipfile.ZipFile(path) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{MAIN}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{MAIN}t")))
        sheets = list(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"))
        chosen = next((s for s in sheets if sheet is None or s.get("name") == sheet), None)
        if chosen is None:
            raise ValueError(f"no sheet {sheet!r} in {path}")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
        target = targets[chosen.get(RELATION)]
        inside = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        with book.open(inside) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{MAIN}row":
                    continue
                out: list[str | None] = []
                for k, cell in enumerate(row.iter(f"{MAIN}c")):
                    at = _column(cell.get("r")) if cell.get("r") else k
                    out += [None] * (at + 1 - len(out))
                    kind, value = cell.get("t"), cell.find(f"{MAIN}v")
                    if kind == "inlineStr":
                        out[at] = "".join(t.text or "" for t in cell.iter(f"{MAIN}t"))
                    elif value is not None and value.text is not None:
                        out[at] = shared[int(value.text)] if kind == "s" else {"0": "false", "1": "true"}[value.text] if kind == "b" else value.text if kind == "str" else _number_text(value.text)
                yield out
                row.clear()


def _files(path: str) -> list[str]:
    return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".xlsx")) if os.path.isdir(path) else [path]


def _header(path: str, sheet: str | None) -> list[tuple[int, str]]:
    first = next(rows_of(path, sheet), [])
    return [(k, v.strip()) for k, v in enumerate(first) if v and v.strip()]


class WideReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None):
        self.path, self.sheet = path, sheet

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in _files(self.path)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = [n for _, n in _header(_files(self.path)[0], self.sheet)]
        rows = rows_of(partition.value, self.sheet)
        header = {v.strip(): k for k, v in enumerate(next(rows, [])) if v and v.strip()}
        for row in rows:
            values = tuple(row[header[n]] if n in header and header[n] < len(row) else None for n in names)
            if any(v is not None and v.strip() for v in values):
                yield values


class WideSpreadsheet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx_wide"

    def schema(self) -> StructType:
        return StructType([StructField(n, StringType()) for _, n in _header(_files(self.options["path"])[0], self.options.get("sheet"))])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WideReader(self.options["path"], self.options.get("sheet"))
