"""Workbook reader (S1, S2): a folder of ``.xlsx`` files as a cells table.

``read_cells`` lists files with the ``binaryFile`` source, deals their sheets out (one row a sheet) and parses each
inside a task (standard-library zip + XML), so a folder of thousands of releases, or one workbook of many large sheets,
is read in parallel and no file passes through the driver.  A sheet is pulled through the parser event by event and its
cells leave in Arrow batches, so memory does not grow with the number of cells.  The result is long: (path, sheet,
row, col, text), all 1-based.  ``sheet_frame`` promotes a header row and turns one sheet back
into a wide frame of text cells using DataFrame operations; value columns
stay text until the family transform coerces them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS_SCHEMA = "path string, sheet string, row int, col int, text string"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_REF = re.compile(r"^([A-Z]+)(\d+)$")


def col_index(letters: str) -> int:
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n


def _sheet_paths(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    target = {r.get("Id"): r.get("Target") for r in rels}
    out = []
    for s in wb.find("m:sheets", _NS):
        rid = s.get(f"{{{_REL_NS}}}id")
        t = target[rid].lstrip("/")
        out.append((s.get("name"), t if t.startswith("xl/") else f"xl/{t}"))
    return out


def _shared_string_events(stream) -> Iterator[str]:
    """The shared strings in order; each element is dropped once read."""
    si, t, rph = (f"{{{_NS['m']}}}{n}" for n in ("si", "t", "rPh"))
    root, phonetic, parts = None, 0, []
    for event, e in ET.iterparse(stream, events=("start", "end")):
        if root is None:
            root = e
        if e.tag == rph:
            phonetic += 1 if event == "start" else -1
        if event == "end" and e.tag == t and not phonetic:
            parts.append(e.text or "")
        elif event == "end" and e.tag == si:
            yield "".join(parts)
            parts = []
            root.clear()


def sheet_cells(z: zipfile.ZipFile, sheet_path: str, strings: list[str]) -> Iterator[tuple[int, int, str]]:
    """(row, col, text) of a sheet's non-empty cells, pulled from the parser; a row is dropped once read."""
    c_tag, v_tag, t_tag, row_tag, data_tag = (f"{{{_NS['m']}}}{n}" for n in ("c", "v", "t", "row", "sheetData"))
    data = None
    with z.open(sheet_path) as stream:
        for event, e in ET.iterparse(stream, events=("start", "end")):
            if event == "start":
                data = e if e.tag == data_tag else data
                continue
            if e.tag == c_tag:
                m = _REF.match(e.get("r", ""))
                if not m:
                    continue
                kind = e.get("t")
                if kind == "inlineStr":
                    text = "".join(x.text or "" for x in e.iter(t_tag))
                else:
                    v = e.find(v_tag)
                    if v is None or v.text is None:
                        continue
                    text = strings[int(v.text)] if kind == "s" else v.text
                if text != "":
                    yield int(m.group(2)), col_index(m.group(1)), text
            elif e.tag == row_tag and data is not None:
                data.clear()


CELL_BATCH = 20_000  # cells of an Arrow batch


def _cell_batches(path: str, name: str, cells: Iterator[tuple[int, int, str]], size: int = CELL_BATCH) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int, str]] = []

    def batch() -> pa.RecordBatch:
        row, col, text = zip(*held)
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([name] * n, pa.string()), pa.array(row, pa.int32()),
                                           pa.array(col, pa.int32()), pa.array(text, pa.string())], names=["path", "sheet", "row", "col", "text"])

    for cell in cells:
        held.append(cell)
        if len(held) == size:
            yield batch()
            held.clear()
    if held:
        yield batch()


def cells_of(files: DataFrame) -> DataFrame:
    """Cells of workbooks given as (path, content); one row a sheet is dealt out, one task reads a sheet at a time.

    The dealt rows carry the sheet and only the parts of the workbook that it needs: its own XML and the shared strings,
    both still compressed.
    """

    def sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content")):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name, at in _sheet_paths(z):
                        yield pa.record_batch({"path": pa.array([path.as_py()], pa.string()), "sheet": pa.array([name], pa.string()),
                                               "at": pa.array([at], pa.string()), "part": pa.array([_only(z, at)], pa.binary())})

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                path, name, at = (b.column(c)[i].as_py() for c in ("path", "sheet", "at"))
                with zipfile.ZipFile(io.BytesIO(b.column("part")[i].as_py())) as z:
                    strings = list(_shared_string_events(z.open("xl/sharedStrings.xml"))) if "xl/sharedStrings.xml" in z.namelist() else []
                    yield from _cell_batches(path, name, sheet_cells(z, at, strings))

    dealt = files.select("path", "content").mapInArrow(sheets, "path string, sheet string, at string, part binary")
    return dealt.repartition("path", "sheet").mapInArrow(cells, CELLS_SCHEMA)


def _only(z: zipfile.ZipFile, at: str) -> bytes:
    """A small workbook with one sheet and the shared strings."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as small:
        for name in (at, "xl/sharedStrings.xml"):
            if name in z.namelist():
                with z.open(name) as source, small.open(name, "w") as target:
                    while piece := source.read(1 << 20):
                        target.write(piece)
    return out.getvalue()


def read_cells(spark: SparkSession, folder: str, glob: str = "*.xlsx") -> DataFrame:
    """Cells of every workbook under ``folder`` (one task per sheet)."""
    return cells_of(spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder))


def header_names(cells: DataFrame, header_rows: list[int]) -> dict[int, str]:
    """Header text per column; several header rows are joined with ``_`` (S2).  A tiny list."""
    h = cells.where(F.col("row").isin(header_rows)).groupBy("col").agg(
        F.concat_ws("_", F.transform(F.array_sort(F.collect_list(F.struct("row", F.trim("text").alias("t")))), lambda e: e["t"])).alias("name")
    )
    return {r["col"]: r["name"] for r in h.collect()}


def sheet_frame(cells: DataFrame, sheet: str, header_row: int, header_rows: int = 1, path: str | None = None) -> DataFrame:
    """One sheet as a wide frame of text cells, columns named by the header row(s).

    Rows above the header (preamble) are dropped; duplicate header names get
    a ``.1``, ``.2`` suffix as in pandas; blank headers become ``Unnamed: i``.
    """
    c = cells.where(F.col("sheet") == sheet)
    if path is not None:
        c = c.where(F.col("path") == path)
    rows = list(range(header_row, header_row + header_rows))
    names = header_names(c, rows)
    body = c.where(F.col("row") >= header_row + header_rows)
    if not names:
        raise ValueError(f"sheet {sheet!r}: no header at row {header_row}")
    ncol = max(names)
    cols = list(range(1, ncol + 1))
    final, seen = [], {}
    for i in cols:
        base = names.get(i) or f"Unnamed: {i - 1}"
        k = seen.get(base, 0)
        final.append(base if k == 0 else f"{base}.{k}")
        seen[base] = k + 1
    wide = body.groupBy("path", "row").pivot("col", cols).agg(F.first("text"))
    # No global sort: tidy transforms order explicitly where order matters.
    return wide.toDF("path", "row", *final).drop("path", "row")


class SheetSpec:
    """How to read one sheet of a family: header row(s) and the transform to the tidy schema."""

    def __init__(self, header_row: int, transform, header_rows: int = 1):
        self.header_row = header_row
        self.header_rows = header_rows
        self.transform = transform


def workbook_family(cells: DataFrame, specs: dict[str, SheetSpec], edition: str, path: str | None = None) -> DataFrame:
    """Every listed sheet of a workbook through its layout transform, stacked by name with
    ``edition`` and ``table_id`` (the sheet id) so the result writes as one partitioned tidy table."""
    from ..operators.tidy import union_all

    frames = []
    for sheet, spec in specs.items():
        wide = sheet_frame(cells, sheet, spec.header_row, spec.header_rows, path)
        tidy = spec.transform(wide)
        frames.append(tidy.withColumn("table_id", F.lit(sheet)).withColumn("edition", F.lit(edition)))
    return union_all(frames)
