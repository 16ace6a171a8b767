"""Files to rows of text cells. Delimited files are read in splits (``delimited``). Of other formats a task reads whole files, one at a time, and gives a row per table row.

Formats without a reader here (the old Excel format, PDF) give a status row, as does anything that
can't be read: a file is never left out in silence.
"""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.delimited import read_delimited
from plumbline.sources.matrices import variables
from plumbline.sources.store import numbered as ordered

#: columns is null where the header has to be found among the rows.
ROWS = (
    "source_path string, source_kind string, source_confidence string, table_name string, table_ord int, row_i bigint, cells array<string>, columns array<string>, status string, message string"
)


def _text(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value) if isinstance(value, (dict, list)) else str(value)


def _status(kind: str, confidence: str, name: str, status: str, message: str):
    yield kind, confidence, name, 0, -1, None, None, status, message


def _listed(kind: str, confidence: str, name: str, number: int, rows: list[list], columns: list[str] | None = None):
    for i, row in enumerate(rows):
        yield kind, confidence, name, number, i, [_text(x) for x in row], columns, None, None


def read_points(name: str, data: bytes, kind: str, confidence: str):
    """The points beside an image: a small file."""
    delimiter = "\t" if name.lower().endswith(".tsv") else ","
    yield from _listed(kind, confidence, name, 0, list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline=""), delimiter=delimiter)))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as part:
        for _, item in ET.iterparse(part):
            if item.tag == f"{_NS}si":
                out.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
                item.clear()
    return out


def _column(reference: str | None) -> int:
    """The number, from 0, of a cell's column; -1 if it isn't said."""
    at = 0
    for letter in re.match("[A-Z]*", reference or "")[0]:
        at = at * 26 + ord(letter) - 64
    return at - 1


def _sheet_rows(part, shared: list[str]) -> Iterator[list[str]]:
    """A sheet's rows, from its XML as a stream: each row's elements are let go when it is read."""
    number, parents = 0, []
    for event, found in ET.iterparse(part, events=("start", "end")):
        if event == "start":
            parents.append(found)
            continue
        parents.pop()
        if found.tag != f"{_NS}row":
            continue
        cells: dict[int, str] = {}
        for c in found.iter(f"{_NS}c"):
            at, value = _column(c.get("r")), c.find(f"{_NS}v")
            at = at if at >= 0 else max(cells, default=-1) + 1
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
            elif value is not None:
                cells[at] = shared[int(value.text)] if c.get("t") == "s" else value.text or ""
        for _ in range(number + 1, int(found.get("r") or number + 1)):
            number += 1
            yield []
        number += 1
        yield [cells.get(i, "") for i in range(max(cells, default=-1) + 1)]
        if parents:
            parents[-1].remove(found)


def read_xlsx(name: str, data: bytes):
    """Every sheet of a workbook that has a text, a row at a time. Shared strings are held, once each."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = _shared(book)
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        number = 0
        for sheet in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet"):
            target = links[sheet.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")].lstrip("/")
            with book.open(target if target.startswith("xl/") else f"xl/{target}") as part:
                blank, any_text = 0, False
                for i, row in enumerate(_sheet_rows(part, shared)):
                    if not any_text and not any(row):
                        blank += 1  # rows before the first text: of a sheet without any, none is given
                        continue
                    if not any_text:
                        any_text = True
                        for k in range(blank):
                            yield "table", "raw_table", sheet.get("name"), number, k, [], None, None, None
                    yield "table", "raw_table", sheet.get("name"), number, i, row, None, None, None
                number += any_text


def read_json(name: str, data: bytes):
    value = json.loads(data.decode("utf-8-sig"))
    if isinstance(value, list) and value and isinstance(value[0], dict):
        columns = sorted({str(k) for row in value for k in row})
        yield from _listed("array", "raw_table", name, 0, [[row.get(c, "") for c in columns] for row in value], columns)
    elif isinstance(value, list) and value and isinstance(value[0], list):
        columns = [f"col_{i + 1}" for i in range(max(map(len, value)))]
        yield from _listed("array", "raw_table", name, 0, value, columns)
    elif isinstance(value, dict) and (columns := [str(k) for k, v in value.items() if isinstance(v, list)]):
        longest = max(len(value[c]) for c in columns)
        yield from _listed("array", "raw_table", name, 0, [[value[c][i] if i < len(value[c]) else "" for c in columns] for i in range(longest)], columns)
    else:
        yield from _status("array", "metadata_only", name, "json_not_tabular", "The JSON holds no simple table.")


def _array(name: str, number: int, array):
    if array.ndim == 1:
        yield from _listed("array", "raw_table", name, number, [[x] for x in array.tolist()], ["value"])
    elif array.ndim == 2:
        yield from _listed("array", "raw_table", name, number, array.tolist(), [f"col_{i + 1}" for i in range(array.shape[1])])
    else:
        yield from _status("array", "metadata_only", name, "array_not_2d", f"An array of {array.ndim} dimensions was left out.")


def read_numpy(name: str, data: bytes):
    import numpy as np

    found = np.load(io.BytesIO(data), allow_pickle=False)
    if hasattr(found, "files"):
        for i, key in enumerate(found.files):
            yield from _array(key, i, found[key])
    else:
        yield from _array(name, 0, found)


def read_mat(name: str, data: bytes):
    """Numeric variables of a level-5 file; a status row for each other one."""
    number = 0
    for key, value in variables(data):
        if isinstance(value, str):
            yield from _status("array", "metadata_only", key, "mat_not_numeric", f"{key}: a variable of class {value} was left out.")
        else:
            yield from _array(key, number, value)
            number += 1
    if not number:
        yield from _status("array", "metadata_only", name, "mat_no_arrays", "The file has no numeric variable.")


def read_pdf(name: str, data: bytes):
    try:
        import pdfplumber
    except ImportError:
        yield from _status("pdf", "not_extracted", name, "pdfplumber dependency missing", "Tables in PDF files need pdfplumber.")
        return
    number = 0
    with pdfplumber.open(io.BytesIO(data)) as pdf:
        for p, page in enumerate(pdf.pages, 1):
            for t, table in enumerate(page.extract_tables() or [], 1):
                if table:
                    yield from _listed("pdf", "pdf_extracted", f"page_{p}_table_{t}", number, table)
                    number += 1
    if not number:
        yield from _status("pdf", "metadata_only", name, "pdf_no_tables", "The PDF has no table that can be extracted.")


def read_file(path: str, data: bytes, kind: str):
    name = path.rsplit("/", 1)[-1]
    low = name.lower()
    if kind == "sidecar":
        yield from read_points(name, data, "image", "estimated")
    elif low.endswith(".xlsx"):
        yield from read_xlsx(name, data)
    elif low.endswith(".xls"):
        yield from _status("table", "not_extracted", name, "xlrd dependency missing", "Workbooks of the old format need xlrd.")
    elif low.endswith(".json"):
        yield from read_json(name, data)
    elif low.endswith((".npy", ".npz")):
        yield from read_numpy(name, data)
    elif low.endswith(".mat"):
        yield from read_mat(name, data)
    elif low.endswith(".pdf"):
        yield from read_pdf(name, data)
    else:
        yield from _status("image", "metadata_only", name, "image_not_digitized", "No digitized points lie beside the image.")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [f.strip().split()[0] for f in ROWS.split(", ")]
    for batch in batches:
        for path, as_path, data, kind in zip(batch["path"], batch["as_path"], batch["content"], batch["kind"], strict=True):
            rows = read_file(path, bytes(data) if data is not None else b"", kind)
            part: list[tuple] = []
            while True:
                try:
                    row = next(rows, None)
                except Exception as e:  # one unreadable file is a status row, not the end of the job
                    row, rows = next(_status("table", "not_extracted", path.rsplit("/", 1)[-1], "unreadable", f"{type(e).__name__}: {e}")), iter(())
                if row is not None:
                    part.append((as_path, *row))
                if part and (row is None or len(part) == 20_000):
                    yield pd.DataFrame(part, columns=names)
                    part = []
                if row is None:
                    break


def extract_rows(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Rows of the tables in all files of an inventory. Points beside an image are read for the image, and as a file of their own."""
    from plumbline.sources.files import sidecars

    beside = sidecars(files)
    asked = (
        files.where("kind <> 'image'").select("path", F.col("path").alias("as_path"), F.lit("file").alias("kind"))
        .unionByName(beside.where("sidecar is not null").select(F.col("sidecar").alias("path"), F.col("path").alias("as_path"), F.lit("sidecar").alias("kind")))
    )
    none = beside.where("sidecar is null").select("path", F.col("path").alias("as_path"), F.lit(None).cast("binary").alias("content"), F.lit("image").alias("kind"))
    roots = [r["root"] for r in files.select(F.expr("substring(path, 1, length(path) - length(relative_path))").alias("root")).distinct().limit(2).collect()]
    if not roots:
        return spark.createDataFrame([], ROWS)
    root = roots[0]
    if len(roots) > 1:
        raise ValueError(f"the files are of more than one inventory: below {roots[0]} and {roots[1]}")
    # Contents are read where they are parsed, a file to a row.
    split = F.lower("path").rlike(r"\.(csv|tsv)$") & (F.col("kind") == "file")
    contents = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    whole = contents.join(asked.where(~split), "path").select("path", "as_path", "content", "kind").unionByName(none).mapInPandas(_read, ROWS)
    rows, bad = read_delimited(spark, root, only=asked.where(split))
    name = F.regexp_extract("path", "([^/]*)$", 1).alias("table_name")
    lit = F.lit
    good = rows.select(F.col("path").alias("source_path"), lit("table").alias("source_kind"), lit("raw_table").alias("source_confidence"), name, lit(0).alias("table_ord"), "row_i", "cells", lit(None).cast("array<string>").alias("columns"), *[lit(None).cast("string").alias(c) for c in ("status", "message")])
    wrong = bad.select(F.col("path").alias("source_path"), lit("table").alias("source_kind"), lit("not_extracted").alias("source_confidence"), name, lit(0).alias("table_ord"), lit(-1).cast("bigint").alias("row_i"), *[lit(None).cast("array<string>").alias(c) for c in ("cells", "columns")], lit("unreadable").alias("status"), "message")
    return whole.unionByName(good).unionByName(wrong)


def numbered(rows: DataFrame) -> DataFrame:
    """rows with table_index: the ordinal of the table in the order of files and of tables within them."""
    key = ["source_path", "source_confidence", "table_ord", "table_name"]
    tables = ordered(rows.select(*key).distinct(), [F.col(k) for k in key], "table_index")
    return rows.join(tables.withColumn("table_index", (F.col("table_index") - 1).cast("int")), key)
