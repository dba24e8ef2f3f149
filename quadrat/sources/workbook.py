"""Workbooks (xlsx) as a Spark data source: sheets are partitions, cells are text. Zip and XML only."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from dataclasses import dataclass
from pathlib import Path
from xml.etree import ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadrat.schemas import UnreadableWorkbook

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MAX_SHEET_NAME = 31


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _archive(data: bytes | str) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data) if isinstance(data, bytes) else data)


def sheets(data: bytes | str) -> list[tuple[str, str]]:
    """Names and part names of a workbook's sheets, in order. data: its bytes, or its path."""
    with _archive(data) as z:
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        book = ET.fromstring(z.read("xl/workbook.xml"))
        return [(s.get("name"), "xl/" + rels[s.get(_REL)].removeprefix("/xl/")) for s in book.find("m:sheets", _NS)]


def rows(data: bytes | str, part: str):
    """The rows of a sheet, as lists of text or None."""
    with _archive(data) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))]
        with z.open(part) as f:
            for _, row in ET.iterparse(f):
                if row.tag != f"{{{_NS['m']}}}row":
                    continue
                out: list[str | None] = []
                for k, c in enumerate(row):
                    at = _column(c.get("r")) if c.get("r") else k
                    out += [None] * (at + 1 - len(out))
                    v = c.find("m:v", _NS)
                    if c.get("t") == "inlineStr":
                        out[at] = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                    elif v is not None:
                        out[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                yield out
                row.clear()


@dataclass
class SheetPartition(InputPartition):
    path: str
    size: int
    modified: int
    sheet: str
    part: str


class WorkbookReader(DataSourceReader):
    """A partition for each sheet; a sheet's rows stream from its part of the file."""

    def __init__(self, options):
        self.paths, self.nrows, self.sheet = options.get("path"), int(options.get("nrows", -1)), options.get("sheet")

    def files(self) -> list[Path]:
        at = Path(self.paths.removeprefix("file://"))
        if not at.exists():
            raise UnreadableWorkbook(f"{at}: no such file or folder")
        return sorted(at.rglob("*.xlsx")) if at.is_dir() else [at]

    def partitions(self):
        out = []
        for f in self.files():
            try:
                named = sheets(str(f))
            except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                raise UnreadableWorkbook(f"{f}: {type(e).__name__}: {e}") from e
            s = f.stat()
            out += [SheetPartition(str(f), s.st_size, s.st_mtime_ns // 1_000_000, name, part) for name, part in named if self.sheet in (None, name)]
        return out

    def read(self, partition: SheetPartition):
        try:
            for k, cells in enumerate(rows(partition.path, partition.part)):
                if k == self.nrows:
                    return
                yield partition.path, partition.size, partition.modified, partition.sheet, k, cells
        except (zipfile.BadZipFile, KeyError, ET.ParseError, zlib.error) as e:
            raise UnreadableWorkbook(f"{partition.path}, sheet {partition.sheet}: {type(e).__name__}: {e}") from e


class WorkbookSource(DataSource):
    """``spark.read.format("workbook")``: path, size, modified (milliseconds), sheet, row (from 0) and cells of all workbooks under a path.

    The path is a file or folder that the driver and the executors see alike. Options: ``nrows``, the rows of each sheet to read (a
    look at headers reads no further), and ``sheet``, the one to read. A file that is no workbook fails as UnreadableWorkbook.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, size long, modified long, sheet string, row int, cells array<string>"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options)


def open_workbooks(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The workbook source, registered with the session."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("workbook").options(**options).load(path)


def headers(spark: SparkSession, path: str, rows_: int = 5) -> DataFrame:
    """path, sheet, header (trimmed names of the first row, null for none) and n_peeked: a look at the first rows of every sheet."""
    x = open_workbooks(spark, path, nrows=str(rows_)).groupBy("path", "sheet").agg(F.max_by("cells", -F.col("row")).alias("cells"), F.count("*").alias("n_peeked"))
    return x.select("path", "sheet", F.transform("cells", lambda c: F.nullif(F.trim(c), F.lit(""))).alias("header"), "n_peeked")


def identities(book: DataFrame) -> DataFrame:
    """path, size, modified and an identity of each file, which changes with any of them."""
    return book.select("path", "size", "modified").distinct().withColumn("identity", F.sha2(F.concat_ws("|", "path", F.col("size").cast("string"), F.col("modified").cast("string")), 256))


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row (from 0), cells (array of text) of every sheet of every workbook under the path; Spark reads the files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def parse(frames):
        import pandas as pd

        for pdf in frames:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                for name, part in sheets(data):
                    own = list(rows(data, part))
                    if own:
                        yield pd.DataFrame({"path": p, "sheet": name, "row": range(len(own)), "cells": own})

    return files.mapInPandas(parse, "path string, sheet string, row int, cells array<string>")


def sheet_frame(book: DataFrame, sheet: str) -> DataFrame:
    """One sheet as columns of text, named by its first row; its name goes to ``Market``. Columns without a name are left out."""
    own = book.where(F.col("sheet") == sheet)
    head = own.where("row = 0").select("cells").first()
    names = [(k, n.strip()) for k, n in enumerate(head["cells"]) if n and n.strip() and not n.startswith("Unnamed")] if head else []
    return own.where("row > 0").select(F.lit(sheet).alias("Market"), *(F.get("cells", F.lit(k)).alias(n) for k, n in names))


def workbook_bytes(frames: dict[str, tuple[list[str], list[tuple]]]) -> bytes:
    """A workbook of the frames (names and rows) with inline text; names are cut to 31 characters, and none makes a notice sheet."""
    frames = frames or {"Notice": (["notice"], [("nothing to export",)])}
    esc = lambda v: str(v).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")

    def cell(v):
        if v is None:
            return "<c/>"
        if isinstance(v, int | float) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{esc(v)}</t></is></c>'

    out = io.BytesIO()
    ns = f'xmlns="{_NS["m"]}"'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{k}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(frames) + 1)) + "</Relationships>")
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{esc(n[:MAX_SHEET_NAME])}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(frames, 1)) + "</sheets></workbook>")
        for k, (names, data) in enumerate(frames.values(), 1):
            body = "".join(f"<row>{''.join(map(cell, r))}</row>" for r in [names, *data])
            z.writestr(f"xl/worksheets/sheet{k}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def export_sheets(sheets_: dict[str, DataFrame | None], at: str) -> None:
    """One folder of Parquet for each sheet that is there: a chart's data may be of any size."""
    for name, df in sheets_.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{at}/{name[:MAX_SHEET_NAME]}")
