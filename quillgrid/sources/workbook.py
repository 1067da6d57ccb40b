"""Workbook scan: xlsx files to cell rows, a file a task, sheets one after the other.

Files come through Spark's own binary reader, so any store that Spark reads will do; the XML is read as a stream. Formula
cells carry their cached value; a merged cell points to the top left one. Empty cells are left out.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, sheet string, sheet_no int, row int, col int, num double, txt string, tag string, formula string, merge_parent string"
FIELDS = pa.schema([("path", pa.string()), ("sheet", pa.string()), ("sheet_no", pa.int32()), ("row", pa.int32()), ("col", pa.int32()), ("num", pa.float64()), ("txt", pa.string()), ("tag", pa.string()), ("formula", pa.string()), ("merge_parent", pa.string())])
ROWS = 10_000  # of a batch
REF = re.compile(r"([A-Z]+)(\d+)")


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def position(ref: str) -> tuple[int, int]:
    """Row and column of a reference such as AB12."""
    letters, row = REF.match(ref).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(row), col


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter() if _name(t.tag) == "t") for item in root]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file) in the workbook's order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _name(s.tag) == "sheet":
            target = links[next(v for k, v in s.attrib.items() if _name(k) == "id")]
            out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
    return out


def _value(kind: str, text: str | None, shared: list[str]) -> tuple[float | None, str | None, str]:
    if text is None:
        return None, None, "empty"
    if kind == "s":
        return None, shared[int(text)], "string"
    if kind in ("str", "inlineStr", "d"):
        return None, text, "date" if kind == "d" else "string"
    if kind == "b":
        return float(text), None, "bool"
    if kind == "e":
        return None, text, "error"
    return float(text), None, "number"


def cells_of(content: bytes) -> Iterator[tuple]:
    """(sheet, sheet_no, row, col, num, txt, tag, formula, merge_parent) of one workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        for number, (sheet, file) in enumerate(_sheets(book)):
            merges = []
            with book.open(file) as f:  # merges stand after the cells
                for _, node in ElementTree.iterparse(f):
                    if _name(node.tag) == "mergeCell":
                        a, _, b = node.get("ref").partition(":")
                        merges.append((*position(a), *position(b or a)))
                    if _name(node.tag) == "row":
                        node.clear()
            with book.open(file) as f:
                for _, node in ElementTree.iterparse(f):
                    if _name(node.tag) != "row":
                        continue
                    for c in node:
                        parts = {_name(x.tag): x for x in c}
                        text = parts["v"].text if "v" in parts else "".join(t.text or "" for t in parts["is"].iter() if _name(t.tag) == "t") if "is" in parts else None
                        formula = f"={parts['f'].text}" if "f" in parts and parts["f"].text else None
                        if text is None and formula is None:
                            continue
                        row, col = position(c.get("r"))
                        num, txt, tag = _value(c.get("t", "n"), text, shared)
                        held = next((m for m in merges if m[0] <= row <= m[2] and m[1] <= col <= m[3] and (row, col) != m[:2]), None)
                        yield sheet, number, row, col, num, txt, "formula" if formula else tag, formula, f"{sheet}_{held[0]}_{held[1]}" if held else None
                    node.clear()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows: list[tuple] = []
            for cell in cells_of(content.as_py()):
                rows.append((path, *cell))
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=FIELDS)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FIELDS, strict=True)], schema=FIELDS)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Cells of every xlsx file under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_scan, SCHEMA)
