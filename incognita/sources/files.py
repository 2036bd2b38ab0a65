"""Folders of office and text files as fragments.

Spark lists and reads the files; only the unpacking of one file's bytes is Python, in tasks. A file that can't be read
is a row with an error, not a failed job. PDF and other formats are rows with an error too, for the caller to copy.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import quote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incognita.functions.headers import kind_by_header

# What is skipped and what is read.
SKIPPED = "(^|/)(\\.|~\\$|\\.~lock|Thumbs\\.db$|desktop\\.ini$)|\\.tmp$"
TEXT, TABLES, OFFICE = ("txt", "md"), ("csv", "tsv"), ("docx", "docm", "pptx", "pptm", "xlsx", "xlsm")
HEADER_ROWS = 10
SNIFFED_CHARS = 20_000
FRAGMENTS = "path string, part string, row int, col int, text string, error string"
_PARAGRAPHS = re.compile(r"^(word/(document|header\d*|footer\d*|footnotes|endnotes|comments)|ppt/(slides|notesSlides)/[^/]+)\.xml$")
_SHEET = re.compile(r"^xl/worksheets/sheet\d+\.xml$")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, length, sha256 and content of the files under a folder, without hidden and temporary ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").split("://")[-1]
    below = F.substring_index(F.substring_index("path", root, -1), quote(root), -1)
    return files.filter(~below.rlike(SKIPPED)).select("path", "length", F.sha2("content", 256).alias("sha256"), "content")


def decode(raw: bytes) -> str:
    """UTF-8, with or without a mark, else Windows-1251; bytes with a zero near the beginning are no text."""
    if raw.startswith(b"\xef\xbb\xbf"):
        return raw.decode("utf-8-sig")
    try:
        return raw.decode()
    except UnicodeDecodeError:
        if b"\0" in raw[:4096]:
            raise ValueError("not a text") from None
        return raw.decode("cp1251", "replace")


def _table(name: str, text: str) -> Iterator[tuple[str, int, int, str]]:
    if name.endswith(".tsv"):
        sep = "\t"
    else:
        try:
            sep = csv.Sniffer().sniff(text[:SNIFFED_CHARS], ",;\t|").delimiter
        except csv.Error:
            sep = ";" if text.count(";") > text.count(",") else ","
    for r, cells in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=sep)):
        for c, cell in enumerate(cells):
            yield "", r, c, cell


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _paragraphs(part: str, raw: bytes) -> Iterator[tuple[str, int, int, str]]:
    """Texts between line breaks and tabs of each paragraph; a paragraph within another is one of its own."""
    owner: dict[int, list[str]] = {}
    order: list[int] = []

    def walk(node, at: int) -> None:
        kind = _local(node.tag)
        if kind == "p":
            at = len(order)
            order.append(at)
            owner[at] = [""]
        elif at >= 0 and kind == "t":
            owner[at][-1] += node.text or ""
        elif at >= 0 and kind in ("br", "cr", "tab"):
            owner[at].append("")
        for child in node:
            walk(child, at)

    walk(ElementTree.fromstring(raw), -1)
    for at in order:
        for k, text in enumerate(owner[at]):
            if text:
                yield part, at, k, text


def _cells(part: str, raw: bytes, strings: list[str]) -> Iterator[tuple[str, int, int, str]]:
    for cell in ElementTree.fromstring(raw).iter():
        if _local(cell.tag) != "c":
            continue
        letters, number = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r", "A1")).groups()
        column = 0
        for letter in letters:
            column = column * 26 + ord(letter) - 64
        value = next((x.text or "" for x in cell if _local(x.tag) == "v"), "")
        if cell.get("t") == "s" and value:
            value = strings[int(value)]
        elif cell.get("t") == "inlineStr":
            value = "".join(x.text or "" for x in cell.iter() if _local(x.tag) == "t")
        if value:
            yield part, int(number) - 1, column - 1, value


def _office(raw: bytes) -> Iterator[tuple[str, int, int, str]]:
    with zipfile.ZipFile(io.BytesIO(raw)) as package:
        strings: list[str] = []
        if "xl/sharedStrings.xml" in package.namelist():
            for item in ElementTree.fromstring(package.read("xl/sharedStrings.xml")):
                strings.append("".join(x.text or "" for x in item.iter() if _local(x.tag) == "t"))
        for part in package.namelist():
            if _PARAGRAPHS.match(part):
                yield from _paragraphs(part, package.read(part))
            elif _SHEET.match(part):
                yield from _cells(part, package.read(part), strings)
            elif "/embeddings/" in part and part.rpartition(".")[2].lower() in OFFICE:
                for inner, row, col, text in _office(package.read(part)):
                    yield f"{part}!{inner}", row, col, text


def _unpack(path: str, raw: bytes) -> Iterator[tuple[str, int, int, str]]:
    kind = path.rpartition(".")[2].lower()
    if kind in TEXT:
        for i, line in enumerate(decode(raw).splitlines()):
            yield "", i, 0, line
    elif kind in TABLES:
        yield from _table(path.lower(), decode(raw))
    elif kind in OFFICE:
        yield from _office(raw)
    else:
        raise ValueError(f"unsupported: {kind}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "part", "row", "col", "text", "error"]
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            try:
                rows = [(path, *row, None) for row in _unpack(path, content.as_py())]
            except Exception as problem:  # a broken file is a finding, whatever breaks it
                rows = [(path, None, None, None, None, f"{type(problem).__name__}: {problem}"[:200])]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def read_fragments(files: DataFrame) -> DataFrame:
    """path, part, row, col, text and error: lines, cells and paragraphs of files (path, content)."""
    return files.select("path", "content").mapInArrow(_read, FRAGMENTS)


def header_kinds(cells: DataFrame) -> DataFrame:
    """path, part, col, header, header_row and kind, from the first of ten rows that has two cells and a known header."""
    top = cells.filter((F.col("row") < HEADER_ROWS) & (F.trim("text") != "")).withColumn("kind", kind_by_header(F.col("text")))
    rows = top.groupBy("path", "part", "row").agg(F.count("*").alias("n"), F.count("kind").alias("known")).filter("n >= 2 and known >= 1")
    first = rows.groupBy("path", "part").agg(F.min("row").alias("row"))
    return top.join(first, ["path", "part", "row"]).select("path", "part", "col", F.col("text").alias("header"), F.col("row").alias("header_row"), "kind")


def numeric_text(value: Column) -> Column:
    """The digits of a whole number in a cell, however it is written; null for other cells."""
    whole = value.rlike("^[0-9]+(\\.0+)?$|^[0-9](\\.[0-9]+)?[Ee]\\+?[0-9]+$")
    number = value.try_cast("decimal(38,6)")
    return F.when(whole & (number == F.floor(number)), F.floor(number).cast("string"))


def with_hints(cells: DataFrame) -> DataFrame:
    """Fragments of tables: each cell below a header row with its column's kind as hint, and its header."""
    kinds = header_kinds(cells)
    joined = cells.join(kinds, ["path", "part", "col"], "left")
    below = F.col("row") > F.col("header_row")
    return joined.select(*cells.columns, F.when(below, F.col("kind")).alias("hint"), F.when(below, F.col("header")).alias("header"))
