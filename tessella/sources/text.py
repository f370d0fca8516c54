"""Delimited text and spreadsheets as tables of strings with a dense row id."""

from __future__ import annotations

import codecs
import csv
import io
import zipfile
from collections.abc import Iterator
from itertools import islice
from pathlib import PurePosixPath
from statistics import fmean, pvariance
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.sources.delimited import PYTHON_NAMES, ROW_ID, DelimitedFile

DELIMITERS = (",", "\t", ";", "|")
HEAD_BYTES, PREVIEW_ROWS = 2 << 20, 30
EXTENSIONS = ("csv", "tsv", "txt", "xlsx", "xls", "xlsm")


def detect_encoding(head: bytes) -> str:
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")):
        if head.startswith(mark):
            return name
    try:
        (head[:-4] if len(head) >= HEAD_BYTES else head).decode("utf-8")
    except UnicodeDecodeError as e:
        # A character cut off at the end of a long head is no sign of another encoding.
        return "utf-8" if len(head) >= HEAD_BYTES and e.start >= len(head) - 8 else "shift_jis"
    return "utf-8"


def decode(data: bytes, encoding: str) -> str:
    """Text without its byte order mark; an unknown encoding is read as UTF-8."""
    return data.decode(PYTHON_NAMES.get(encoding, "utf-8"), errors="replace").removeprefix("﻿")


def _cells(line: str, delimiter: str) -> int:
    quoted, n = False, 0
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c == delimiter and not quoted:
            n += 1
    return n


def detect_delimiter(text: str) -> str:
    """The candidate that occurs outside quotes most often and most evenly in the first 20 lines; a comma without any."""
    lines = [x for x in text.splitlines() if x.strip()][:20]
    best, top = ",", 0.0
    for d in DELIMITERS:
        counts = [_cells(x, d) for x in lines]
        if any(counts):
            score = fmean(counts) - 2 * pvariance(counts) + 2 * sum(map(bool, counts)) / len(counts)
            if score > top:
                best, top = d, score
    return best


def parse_text(text: str, delimiter: str = ",") -> list[list[str]]:
    """Rows of a small text: doubled quotes, line ends of any kind, blank lines passed over, an open quote closed at the end."""
    rows = csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)
    return [r for r in rows if r and r != [""]]


def header_names(cells: list[str]) -> list[str]:
    """Trimmed names, none empty, none twice."""
    seen: dict[str, int] = {}
    out: list[str] = []
    for k, cell in enumerate(cells):
        name = cell.replace("﻿", "").strip() or f"列{k + 1}"
        n = seen[name] = seen.get(name, 0) + 1
        if n > 1:
            while f"{name}_{n}" in seen:
                n += 1
            name = f"{name}_{n}"
            seen[name] = 1
        out.append(name)
    return out


def with_row_id(df: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """A dense id from 0 in the order of partitions: one pass counts them, one numbers the rows."""
    tagged = df.withColumn("__m", F.monotonically_increasing_id())
    part, at = F.shiftrightunsigned("__m", 33), F.col("__m").bitwiseAND((1 << 33) - 1)
    sizes = {r.p: r.n for r in tagged.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a partition
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p] = total
        total += sizes[p]
    if not starts:
        return tagged.select(F.lit(0).cast("long").alias(row_id), *df.columns).limit(0)
    bases = df.sparkSession.createDataFrame(list(starts.items()), "__p long, __base long")
    joined = tagged.join(F.broadcast(bases), part == F.col("__p"))  # two numbers a partition
    return joined.select((F.col("__base") + at).alias(row_id), *[F.col(f"`{c}`") for c in df.columns])


def heads(spark: SparkSession, path: str, n: int = HEAD_BYTES) -> Iterator[bytes]:
    """The first bytes of a file, or of each file of a folder that has any, in the order of names; by Spark's own file systems."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    at = jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(sc._jsc.hadoopConfiguration())
    parts = [at]
    if files.getFileStatus(at).isDirectory():
        parts = [f.getPath() for f in files.listStatus(at) if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", "."))]
    for part in sorted(parts, key=lambda p: p.getName()):
        stream = files.open(part)
        try:
            yield bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))
        finally:
            stream.close()


def head_bytes(spark: SparkSession, path: str, n: int = HEAD_BYTES) -> bytes:
    """The first bytes of a file, or of a folder's first file that holds a record; none if there is no such file."""
    return next((head for head in heads(spark, path, n) if parse_text(decode(head, detect_encoding(head)))), b"")


def detect_format(spark: SparkSession, path: str) -> tuple[str, str, str]:
    """Encoding, delimiter and the first characters of a delimited file."""
    head = head_bytes(spark, path)
    encoding = detect_encoding(head)
    text = decode(head, encoding)
    return encoding, detect_delimiter(text), text


def open_delimited(spark: SparkSession, path: str, *, delimiter: str | None = None, encoding: str | None = None) -> DelimitedFile:
    """A delimited file, or a folder of files that each have the header; one pass finds where its records are.

    Encoding, delimiter and names are taken from the first file's first ``HEAD_BYTES``.  The files
    must not change between reads.
    """
    found, sniffed, text = detect_format(spark, path)
    if encoding and encoding != found:
        text = decode(head_bytes(spark, path), encoding)
        sniffed = detect_delimiter(text)
    encoding, delimiter = encoding or found, delimiter or sniffed
    head = next(iter(parse_text(text, delimiter)), None)
    if not head:
        raise ValueError("the file is empty")
    return DelimitedFile(spark, path, header_names(head), delimiter=delimiter, encoding=encoding)


def read_delimited(spark: SparkSession, path: str, *, delimiter: str | None = None, encoding: str | None = None) -> DataFrame:
    """All rows of a delimited file as strings."""
    return open_delimited(spark, path, delimiter=delimiter, encoding=encoding).table()


def from_text(spark: SparkSession, text: str, *, delimiter: str | None = None) -> DataFrame:
    """A small text held in memory as a table."""
    delimiter = delimiter or detect_delimiter(text)
    rows = parse_text(text, delimiter)
    if not rows:
        raise ValueError("the text is empty")
    names = header_names(rows[0])
    width = len(names)
    data = [(k, *(r + [""] * width)[:width]) for k, r in enumerate(rows[1:])]
    return spark.createDataFrame(data, T.StructType([T.StructField(ROW_ID, T.LongType())] + [T.StructField(n, T.StringType()) for n in names]))


_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of a sheet that are sent at once.
SHEET_ROWS = 4096


def first_sheet(book: zipfile.ZipFile) -> str:
    """The part of a workbook that holds its first sheet, in the order that the workbook gives."""
    names = set(book.namelist())
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= names:
        targets = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
            target = targets.get(sheet.get(_REL), "")
            part = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            if part in names:
                return part
    parts = sorted((n for n in names if n.startswith("xl/worksheets/sheet")), key=lambda n: (len(n), n))
    if not parts:
        raise ValueError("the workbook has no sheet")
    return parts[0]


def sheet_rows(data: bytes) -> Iterator[list[str]]:
    """The rows of the first sheet of an xlsx or xlsm file as text, one at a time; rows without any text are passed over."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in book.namelist():
            with book.open("xl/sharedStrings.xml") as part:
                for _, item in ElementTree.iterparse(part):
                    if item.tag == f"{_MAIN}si":
                        shared.append("".join(t.text or "" for t in item.iter(f"{_MAIN}t")))
                        item.clear()
        with book.open(first_sheet(book)) as part:
            for _, row in ElementTree.iterparse(part):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = 0
                    for x in c.get("r", ""):
                        if x.isalpha():
                            at = at * 26 + ord(x.upper()) - 64
                    at = at or len(cells) + 1
                    cells += [""] * (at - len(cells))
                    value = c.find(f"{_MAIN}v")
                    text = value.text or "" if value is not None else "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    kind = c.get("t")
                    cells[at - 1] = shared[int(text)] if kind == "s" and text else {"1": "TRUE", "0": "FALSE"}.get(text, text) if kind == "b" else text
                row.clear()
                if any(cells):
                    yield cells


def _sheet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column(0).to_pylist():
            rows = enumerate(sheet_rows(data))
            while held := list(islice(rows, SHEET_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([r for _, r in held], pa.list_(pa.string()))], names=["row", "cells"])


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook as strings, parsed by the task that reads it; the driver gets its header alone.

    A workbook is one compressed file, and so one task's, which goes through it row by row.
    """
    if path.lower().endswith(".xls"):
        raise ValueError("old .xls files aren't supported here: save the file as .xlsx")
    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_sheet, "row long, cells array<string>")
    head = rows.filter("row = 0").first()
    if head is None:
        raise ValueError("the sheet is empty")
    names = header_names(head.cells)
    cells = [F.coalesce(F.get("cells", F.lit(k)), F.lit("")).alias(f"c{k}") for k in range(len(names))]
    return rows.filter("row > 0").select((F.col("row") - 1).alias(ROW_ID), *cells).toDF(ROW_ID, *names)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table with a row id from any file that is known by its suffix; Parquet keeps its types."""
    suffix = PurePosixPath(path).suffix.lower().lstrip(".")
    if suffix in ("xlsx", "xlsm", "xls"):
        return read_excel(spark, path)
    if suffix in EXTENSIONS:
        return read_delimited(spark, path)
    return with_row_id(spark.read.parquet(path))
