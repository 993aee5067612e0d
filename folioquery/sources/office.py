"""Word, Excel and PowerPoint files.

A small reader opens the zipped XML of one file inside a task and hands out flat rows; headings,
table sentences and slides are then put together by Spark.
"""

import io
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator
from datetime import datetime, timedelta
from itertools import islice
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioquery import constants as K
from folioquery.functions.text import cells_sentence, clean, strip
from folioquery.sources.files import as_documents, scan

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
SHEET_ROWS = 2_000   # rows of a sheet that are handed on at a time
_BUILTIN_DATE_FORMATS = set(range(14, 23)) | set(range(45, 48))


def _xml(book: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(book.read(name)) if name in book.namelist() else None


def _related(book: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relationship id -> (last word of its type, target part)."""
    folder, name = posixpath.split(part)
    rels = _xml(book, f"{folder}/_rels/{name}.rels")
    found = {}
    for rel in rels if rels is not None else []:
        target = rel.get("Target", "")
        target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")
        found[rel.get("Id")] = (rel.get("Type", "").rsplit("/", 1)[-1], target)
    return found


def _joined(node: ET.Element, marks: dict[str, str | None]) -> str:
    """Concatenate the texts below a node; a mark of None takes the element's own text."""
    return "".join((e.text or "") if marks[e.tag] is None else marks[e.tag] for e in node.iter() if e.tag in marks)


_WORD_MARKS = {_W + "t": None, _W + "tab": "\t", _W + "br": "\n", _W + "cr": "\n", _W + "noBreakHyphen": "-"}
_SLIDE_MARKS = {_A + "t": None, _A + "br": "\v"}


def _word_rows(content: bytes) -> Iterator[tuple]:
    """(table_no, ordinal, heading, cells); table 0 holds the paragraphs of the body."""
    book = zipfile.ZipFile(io.BytesIO(content))
    styles = _xml(book, "word/styles.xml")
    names = {s.get(_W + "styleId"): s.find(_W + "name").get(_W + "val", "")
             for s in (styles.iter(_W + "style") if styles is not None else []) if s.find(_W + "name") is not None}
    body = _xml(book, "word/document.xml").find(_W + "body")
    for i, par in enumerate(body.findall(_W + "p")):
        style = par.find(f"{_W}pPr/{_W}pStyle")
        name = names.get(style.get(_W + "val"), "") if style is not None else ""
        yield 0, i, name.lower().startswith("heading"), [_joined(par, _WORD_MARKS)]
    for number, table in enumerate(body.findall(_W + "tbl"), start=1):
        above: list[str] = []
        for r, row in enumerate(table.findall(_W + "tr")):
            cells: list[str] = []
            for cell in row.findall(_W + "tc"):
                merge = cell.find(f"{_W}tcPr/{_W}vMerge")
                span = cell.find(f"{_W}tcPr/{_W}gridSpan")
                if merge is not None and merge.get(_W + "val", "continue") == "continue" and len(cells) < len(above):
                    text = above[len(cells)]
                else:
                    text = "\n".join(_joined(p, _WORD_MARKS) for p in cell.findall(_W + "p"))
                cells += [text.strip()] * (int(span.get(_W + "val")) if span is not None else 1)
            above = cells
            yield number, r, False, cells


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Indexes of the cell styles that show a date."""
    styles = _xml(book, "xl/styles.xml")
    if styles is None:
        return set()
    codes = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter(_S + "numFmt")}

    def is_date(fmt: int) -> bool:
        return fmt in _BUILTIN_DATE_FORMATS or (
            fmt in codes and any(c in "ymdhs" for c in codes[fmt].lower().split(";")[0].replace("general", "")))

    formats = styles.find(_S + "cellXfs")
    return {i for i, x in enumerate(formats if formats is not None else []) if is_date(int(x.get("numFmtId", 0)))}


def _cell_text(cell: ET.Element, shared: list[str], dates: set[int]) -> str | None:
    kind, value = cell.get("t", "n"), cell.findtext(_S + "v")
    if kind == "inlineStr":
        text = "".join(t.text or "" for t in cell.iter(_S + "t"))
    elif value is None:
        return None
    elif kind == "s":
        text = shared[int(value)]
    elif kind == "b":
        text = str(value == "1")
    elif kind == "n":
        number = float(value)
        if int(cell.get("s", 0)) in dates:
            text = str(datetime(1899, 12, 30) + timedelta(seconds=round(number * 86400)))
        else:
            text = str(int(number)) if number.is_integer() else repr(number)
    else:
        text = value
    return None if text in K.NULL_CELLS else text


def _column(reference: str) -> int:
    number = 0
    for letter in reference.rstrip("0123456789"):
        number = number * 26 + ord(letter) - 64
    return number - 1


def _packed(book: zipfile.ZipFile, content: bytes, name: str) -> bytes:
    """A part as it lies in the file, behind one byte that says whether it is deflated."""
    info = book.getinfo(name)
    at = info.header_offset + 30 + sum(struct.unpack_from("<HH", content, info.header_offset + 26))
    return bytes([info.compress_type != zipfile.ZIP_STORED]) + content[at:at + info.compress_size]


def _elements(packed: bytes, tag: str, block: int = 1 << 16) -> Iterator[ET.Element]:
    """The elements of one tag of a packed part, one after the other: neither the part's text nor its tree is held whole."""
    inflate, parser = zlib.decompressobj(-zlib.MAX_WBITS), ET.XMLPullParser(["start", "end"])
    open_elements: list[ET.Element] = []
    for at in range(1, len(packed), block):
        piece = packed[at:at + block]
        parser.feed(inflate.decompress(piece) if packed[0] else piece)
        for event, element in parser.read_events():
            if event == "start":
                open_elements.append(element)
                continue
            open_elements.pop()
            if element.tag == tag:
                yield element
                if open_elements:
                    open_elements[-1].remove(element)


def _sheet_parts(content: bytes) -> Iterator[tuple]:
    """(sheet_no, section, sheet, strings, dates): each sheet of a workbook with what its cells refer to, still packed."""
    book = zipfile.ZipFile(io.BytesIO(content))
    strings = _packed(book, content, "xl/sharedStrings.xml") if "xl/sharedStrings.xml" in book.namelist() else None
    dates, related = sorted(_date_styles(book)), _related(book, "xl/workbook.xml")
    for number, sheet in enumerate(_xml(book, "xl/workbook.xml").iter(_S + "sheet")):
        kind, part = related[sheet.get(_R + "id")]
        if kind == "worksheet" and part in book.namelist():
            yield number, sheet.get("name"), _packed(book, content, part), strings, dates


def _sheet_rows(sheet: bytes, strings: bytes | None, dates: set[int]) -> Iterator[tuple]:
    """(ordinal, cells), the first row of a sheet being its header."""
    shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in _elements(strings, _S + "si")] if strings else []
    for position, row in enumerate(_elements(sheet, _S + "row")):
        ordinal = int(row.get("r", position + 1)) - 1
        cells: list[str | None] = []
        for cell in row.findall(_S + "c"):
            column = _column(cell.get("r")) if cell.get("r") else len(cells)
            cells += [None] * (column - len(cells)) + [_cell_text(cell, shared, dates)]
        yield ordinal, cells


def _shape_text(shape: ET.Element) -> str:
    body = shape.find(_P + "txBody")
    return "" if body is None else "\n".join(_joined(p, _SLIDE_MARKS) for p in body.findall(_A + "p")).strip()


def _slide_rows(content: bytes) -> Iterator[tuple]:
    """(slide, ordinal, is_note, text) for top-level shapes, then the speaker notes."""
    book = zipfile.ZipFile(io.BytesIO(content))
    related = _related(book, "ppt/presentation.xml")
    for number, ref in enumerate(_xml(book, "ppt/presentation.xml").iter(_P + "sldId"), start=1):
        part = related[ref.get(_R + "id")][1]
        tree = _xml(book, part).find(f"{_P}cSld/{_P}spTree")
        for i, shape in enumerate(tree.findall(_P + "sp")):
            yield number, i, False, _shape_text(shape)
        for kind, notes in _related(book, part).values():
            if kind == "notesSlide":
                for shape in _xml(book, notes).iter(_P + "sp"):
                    place = shape.find(f"{_P}nvSpPr/{_P}nvPr/{_P}ph")
                    if place is not None and place.get("type") == "body":
                        yield number, 1_000_000, True, _shape_text(shape)


def _unzip(files: DataFrame, reader, columns: str) -> DataFrame:
    """Run a reader over (file_name, content) rows, a batch of files at a time."""
    names = [c.split()[0] for c in columns.split(", ")]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["file_name"], batch["content"]):
                yield pd.DataFrame([(name, *row) for row in reader(content)], columns=["file_name", *names])

    return files.select("file_name", "content").mapInPandas(rows, f"file_name string, {columns}")


def word_sections(files: DataFrame) -> DataFrame:
    """Paragraphs under their nearest heading, then one sentence per table row."""
    rows = _unzip(files, _word_rows, "table_no int, ordinal int, heading boolean, cells array<string>")
    body = (rows.where("table_no = 0")
            .select("file_name", "ordinal", "heading", strip(F.col("cells")[0]).alias("line")).where("line <> ''"))
    running = W.partitionBy("file_name").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
    sections = (body.withColumn("doc_seq", F.sum(F.col("heading").cast("long")).over(running))
                .groupBy("file_name", "doc_seq")
                .agg(F.max(F.when(F.col("heading"), F.col("line"))).alias("title"),
                     F.sort_array(F.collect_list(F.when(~F.col("heading"), F.struct("ordinal", "line")))).alias("lines")))
    sections = (sections.select(
        "file_name", "doc_seq", F.coalesce("title", F.lit(K.FIRST_SECTION)).alias("section"),
        clean(F.array_join(F.col("lines.line"), "\n")).alias("body")).where("body <> ''")
        .withColumn("text", F.concat_ws("\n", "section", "body")))

    table = W.partitionBy("file_name", "table_no").orderBy("ordinal")
    sentences = (rows.where("table_no > 0")
                 .withColumn("headers", F.first("cells").over(table)).where("ordinal > 0")
                 .select("file_name", (F.col("table_no") * F.lit(1_000_000) + F.col("ordinal")).cast("long").alias("doc_seq"),
                         F.concat(F.lit(K.TABLE_SECTION), F.col("table_no").cast("string")).alias("section"),
                         cells_sentence(F.col("headers"), F.col("cells")).alias("text")).where("text <> ''"))
    return as_documents(sections, "docx").unionByName(as_documents(sentences, "docx"))


def sheet_cells(files: DataFrame) -> DataFrame:
    """(file_name, sheet_no, section, ordinal, cells): the rows of all sheets.

    A workbook is taken apart into its packed sheets, which are dealt out, so that several tasks read a large one; each
    reads its sheet element by element and holds the shared strings and some rows.
    """
    parts = _unzip(files, _sheet_parts, "sheet_no int, section string, sheet binary, strings binary, dates array<int>")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in batch.itertuples(index=False):
                found = _sheet_rows(part.sheet, part.strings, set(part.dates))
                while block := list(islice(found, SHEET_ROWS)):
                    yield pd.DataFrame([(part.file_name, part.sheet_no, part.section, *row) for row in block],
                                       columns=["file_name", "sheet_no", "section", "ordinal", "cells"])

    return (parts.repartition("file_name", "sheet_no")
            .mapInPandas(rows, "file_name string, sheet_no int, section string, ordinal long, cells array<string>"))


def sheet_sentences(files: DataFrame) -> DataFrame:
    """One sentence per row of every sheet; rows without any value are dropped."""
    rows = sheet_cells(files)
    sheet = W.partitionBy("file_name", "sheet_no").orderBy("ordinal")
    filled = rows.withColumn("names", F.first("cells").over(sheet)).withColumn(
        "first_ordinal", F.first("ordinal").over(sheet))
    headers = F.transform("names", lambda name, i: F.coalesce(name, F.concat(F.lit("Unnamed: "), i.cast("string"))))
    row_no = F.col("ordinal") - F.col("first_ordinal") + 1
    return as_documents(filled.where("ordinal > first_ordinal").select(
        "file_name", "section", row_no.alias("row_no"),
        (F.col("sheet_no") * F.lit(10_000_000).cast("long") + row_no).alias("doc_seq"),
        cells_sentence(headers, F.col("cells")).alias("text")).where("text <> ''"), "xlsx")


def slide_documents(files: DataFrame) -> DataFrame:
    """One document per slide: shape texts, then the labelled speaker notes."""
    rows = _unzip(files, _slide_rows, "slide int, ordinal int, is_note boolean, line string").where("line <> ''")
    line = F.when(F.col("is_note"), F.concat(F.lit(K.NOTES_LABEL), "line")).otherwise(F.col("line"))
    slides = rows.groupBy("file_name", "slide").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", line.alias("line")))).alias("lines"))
    return as_documents(slides.select(
        "file_name", "slide", (F.col("slide") - 1).alias("doc_seq"),
        clean(F.array_join(F.col("lines.line"), "\n")).alias("text")).where("text <> ''"), "pptx")


def office_documents(spark: SparkSession, paths, glob: str | None, units) -> DataFrame:
    return units(scan(spark, "binaryFile", paths, glob))
