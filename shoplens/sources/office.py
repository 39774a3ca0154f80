"""Text lines and first sheets of office files, one file per row, read on the executors."""

from __future__ import annotations

import datetime as dt
import io
import re
import sys
import zipfile
from collections.abc import Iterable, Iterator
from itertools import batched
from xml.etree import ElementTree

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoplens.session import reuse

# Task functions travel with the job: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# XML namespaces of the file formats.
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

# Built-in number formats that show a date or time, and the day numbers count from.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
DAY_ZERO = dt.datetime(1899, 12, 30)

# Rows or lines that leave a task at a time.
BATCH = 1000


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(archive.read(name))


def _elements(archive: zipfile.ZipFile, name: str, parent: str, tag: str) -> Iterator[ElementTree.Element]:
    """The ``tag`` elements right below ``parent``, unpacked one by one; those read before are dropped."""
    above: list[ElementTree.Element] = []
    with archive.open(name) as stream:
        for event, element in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if above and above[-1].tag == parent:
                if element.tag == tag:
                    yield element
                above[-1].clear()


def _targets(archive: zipfile.ZipFile, folder: str, part: str) -> dict[str, str]:
    """Relation id -> archive path, as listed next to ``folder/part``."""
    found = {}
    for relation in _xml(archive, f"{folder}/_rels/{part}.rels"):
        target = relation.get("Target", "")
        found[relation.get("Id")] = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
    return found


def _text(paragraph: ElementTree.Element, ns: str) -> str:
    pieces = {f"{ns}t": None, f"{ns}tab": "\t", f"{ns}br": "\n"}
    return "".join((pieces[e.tag] or e.text or "") for e in paragraph.iter() if e.tag in pieces)


def _document_lines(archive: zipfile.ZipFile) -> Iterator[str]:
    for paragraph in _elements(archive, "word/document.xml", f"{WORD}body", f"{WORD}p"):
        yield _text(paragraph, WORD)


def _slide_lines(archive: zipfile.ZipFile) -> Iterator[str]:
    targets = _targets(archive, "ppt", "presentation.xml")
    for slide in _xml(archive, "ppt/presentation.xml").iter(f"{SLIDE}sldId"):
        tree = _xml(archive, targets[slide.get(f"{RELATION}id")]).find(f"{SLIDE}cSld/{SLIDE}spTree")
        for body in tree.findall(f"{SLIDE}sp/{SLIDE}txBody"):
            for paragraph in body.findall(f"{DRAWING}p"):
                yield _text(paragraph, DRAWING)


def _batches(path: str, numbered: Iterable[tuple], number: str, value: str) -> Iterator[pd.DataFrame]:
    for some in batched(numbered, BATCH):
        yield pd.DataFrame({"path": path, number: [n for n, _ in some], value: [x for _, x in some]})


def read_office_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(path, line_no, text)`` of docx and pptx files: stripped, non-blank paragraphs."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    found = _slide_lines(archive) if name.lower().endswith(".pptx") else _document_lines(archive)
                    kept = enumerate((s for s in (line.strip() for line in found) if s), 1)
                    yield from _batches(name, kept, "line_no", "text")

    wanted = files.where(F.lower("path").rlike(r"\.(docx|pptx)$"))
    return wanted.mapInPandas(lines, "path string, line_no long, text string")


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match("[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _date_styles(archive: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    styles = _xml(archive, "xl/styles.xml")
    dates = set(DATE_FORMATS)
    for fmt in styles.findall(f"{SHEET}numFmts/{SHEET}numFmt"):
        shown = re.sub(r'"[^"]*"|\\.|\[[^\]]*\]', "", fmt.get("formatCode", "")).lower()
        if re.search("[ymdh]", shown):
            dates.add(int(fmt.get("numFmtId")))
    return {i for i, xf in enumerate(styles.findall(f"{SHEET}cellXfs/{SHEET}xf")) if int(xf.get("numFmtId", 0)) in dates}


def _cell_text(cell: ElementTree.Element, shared: list[str], dates: set[int]) -> str | None:
    kind, value = cell.get("t", "n"), cell.find(f"{SHEET}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{SHEET}t"))
    if value is None or value.text is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "true" if value.text == "1" else "false"
    if kind == "n" and int(cell.get("s", 0)) in dates:
        moment = DAY_ZERO + dt.timedelta(seconds=round(float(value.text) * 86400))
        return moment.isoformat(" ")
    return value.text


def _sheet_rows(archive: zipfile.ZipFile) -> Iterator[list[str | None]]:
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        for item in _elements(archive, "xl/sharedStrings.xml", f"{SHEET}sst", f"{SHEET}si"):
            shared.append("".join(t.text or "" for t in item.iter(f"{SHEET}t")))
    dates = _date_styles(archive)
    first = _xml(archive, "xl/workbook.xml").find(f"{SHEET}sheets/{SHEET}sheet")
    path = _targets(archive, "xl", "workbook.xml")[first.get(f"{RELATION}id")]
    for row in _elements(archive, path, f"{SHEET}sheetData", f"{SHEET}row"):
        cells: list[str | None] = []
        for cell in row.findall(f"{SHEET}c"):
            at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
            cells += [None] * (at + 1 - len(cells))
            cells[at] = _cell_text(cell, shared, dates)
        yield cells


def _names(cells: list[str | None], width: int) -> list[str]:
    """A name for each of ``width`` columns; repeated names are numbered, unnamed columns too."""
    names: list[str] = []
    for i in range(max(width, len(cells))):
        name = own = (cells[i] if i < len(cells) else None) or f"column_{i}"
        again = 2
        while name in names:
            name, again = f"{own}_{again}", again + 1
        names.append(name)
    return names


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of every file as string columns; each file's first row names its columns.

    The result has the columns of all files, in the order of the files by path. Cells
    beyond the first row are columns too (``column_<number>``); a repeated name gets a number.
    A task holds the packed file and its shared texts; the sheet is unpacked row by row.
    Files are read twice, for the names and for the rows.
    """
    files = spark.read.format("binaryFile").load(path).where(F.lower("path").endswith(".xlsx"))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    yield from _batches(name, enumerate(_sheet_rows(archive)), "row_no", "cells")

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names = [_names(list(first), width) for first, width in zip(batch["first"], batch["width"])]
            yield pd.DataFrame({"path": batch["path"], "names": names})

    sheets = files.select("path", "content").mapInPandas(rows, "path string, row_no long, cells array<string>")
    heads = sheets.groupBy("path").agg(
        F.max(F.when(F.col("row_no") == 0, F.col("cells"))).alias("first"), F.max(F.size("cells")).alias("width")
    ).mapInPandas(named, "path string, names array<string>")
    # One row per file.
    heads = reuse(heads)
    # One row per column name.
    places = heads.select("path", F.posexplode("names").alias("place", "name"))
    found = places.groupBy("name").agg(F.min(F.struct("path", "place")).alias("at")).orderBy("at").collect()
    if not found and files.isEmpty():
        raise ValueError(f"no spreadsheets under {path}")
    body = sheets.where("row_no > 0").join(heads, "path")
    return body.select(*[
        F.get("cells", F.array_position("names", F.lit(r["name"])).cast("int") - 1).alias(r["name"]) for r in found
    ])
