"""Text of DOCX, XLSX and PPTX files (ZIP and XML, read with the standard library), and of PDF files where a library is
installed. In: rows of `spark.read.format("binaryFile")`, or (path, content)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Files whose contents are Python objects at once; Arrow's batches are of thousands.
FILES = 64


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most FILES."""
    for batch in batches:
        for at in range(0, batch.num_rows, FILES):
            yield batch.slice(at, FILES)


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _runs(node: ElementTree.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def _paragraphs(root: ElementTree.Element) -> list[str]:
    return [t for p in root.iter() if _local(p.tag) == "p" and (t := _runs(p).strip())]


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def _docx(z: zipfile.ZipFile) -> str:
    return "\n\n".join(_paragraphs(ElementTree.fromstring(z.read("word/document.xml"))))


def _pptx(z: zipfile.ZipFile) -> str:
    slides = _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml")
    return "\n\n".join(x for s in slides if (x := "\n".join(_paragraphs(ElementTree.fromstring(z.read(s))))))


def _xlsx(z: zipfile.ZipFile) -> str:
    names = z.namelist()
    shared = [_runs(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(x.tag) == "si"] if "xl/sharedStrings.xml" in names else []
    lines = []
    for sheet in _numbered(names, r"xl/worksheets/sheet(\d+)\.xml"):
        for row in (x for x in ElementTree.fromstring(z.read(sheet)).iter() if _local(x.tag) == "row"):
            cells = []
            for cell in (c for c in row if _local(c.tag) == "c"):
                value = next((v.text or "" for v in cell if _local(v.tag) == "v"), "")
                cells.append(_runs(cell) if cell.get("t") == "inlineStr" else shared[int(value)] if cell.get("t") == "s" and value else value)
            if line := " ".join(x for x in cells if x):
                lines.append(line)
    return "\n".join(lines)


def _pdf(raw: bytes) -> str | None:
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    reader = PdfReader(io.BytesIO(raw))
    return None if reader.is_encrypted else "\n\n".join(x for p in reader.pages if (x := (p.extract_text() or "").strip()))


def extract(kind: str, raw: bytes) -> str | None:
    """The text of a file; null if it can't be read."""
    try:
        if kind == "pdf":
            return _pdf(raw)
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return {"docx": _docx, "xlsx": _xlsx, "pptx": _pptx}[kind](z)
    except (KeyError, ValueError, IndexError, zipfile.BadZipFile, ElementTree.ParseError):
        return None


def texts(files: DataFrame) -> DataFrame:
    """(path, doc_type, text) of files (path, content), by the ending of the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            paths = batch.column(0).to_pylist()
            kinds = [(p or "").rpartition(".")[2].lower() for p in paths]
            out = [extract(k, raw or b"") for k, raw in zip(kinds, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(out, pa.string())], names=["path", "doc_type", "text"])

    return files.select("path", "content").mapInArrow(run, "path string, doc_type string, text string")


def from_base64(rows: DataFrame) -> DataFrame:
    """texts() of (path, encoded); what is no base64 gives null."""
    return texts(rows.select("path", F.try_to_binary("encoded", F.lit("base64")).alias("content")))


def packed(rows: DataFrame) -> DataFrame:
    """(path, content) of rows (path, lines): office files, by the ending of the path, with the lines as paragraphs, as those of one slide, or
    as rows of a sheet; other endings give an empty archive."""

    def file(kind: str, lines: list[str]) -> bytes:
        text = [escape("".join(c for c in x or "" if c >= " " or c == "\t")) for x in lines]
        said = "".join(f"<p><r><t>{x}</t></r></p>" for x in text)
        cells = "".join(f'<row><c t="s"><v>{n}</v></c></row>' for n in range(len(text)))
        shared = "".join(f"<si><t>{x}</t></si>" for x in text)
        parts = {"docx": {"word/document.xml": f"<d>{said}</d>"}, "pptx": {"ppt/slides/slide1.xml": f"<d>{said}</d>"}, "xlsx": {"xl/worksheets/sheet1.xml": f"<s>{cells}</s>", "xl/sharedStrings.xml": f"<x>{shared}</x>"}}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, content in parts.get(kind, {}).items():
                z.writestr(name, content)
        return out.getvalue()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            paths = batch.column(0).to_pylist()
            made = [file((p or "").rpartition(".")[2].lower(), lines or []) for p, lines in zip(paths, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    return rows.select("path", "lines").mapInArrow(run, "path string, content binary")
