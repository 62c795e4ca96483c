"""Documents to ordered sections: Markdown by headings, CSV by rows. Rows in: (document_id, text, title_hint)."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import doc_type
from . import openapi

#: Fixed value: the title of what stands before the first heading.
PREAMBLE = "개요"
#: Where a line ends, and what begins a heading.
_LINE = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
_HEADING = r"^(#{1,6})(?U:\s+)(.*)$"


def _trim(text):
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def markdown_sections(docs: DataFrame) -> DataFrame:
    """(document_id, order_index, title, content): the lines under each heading; sections without content are left out."""

    def once(value, use):
        """What a lambda reads for every element is worked out once, as its own element."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    def made(lines, heads):
        def section(at, end):
            title = F.when(at < 0, PREAMBLE).otherwise(_trim(F.regexp_extract(F.get(lines, at), _HEADING, 2)))
            return F.struct(title.alias("title"), _trim(F.array_join(F.slice(lines, at + 2, end - at - 1), "\n")).alias("content"))

        cut = F.zip_with(F.concat(F.array(F.lit(-1)), heads), F.concat(heads, F.array(F.size(lines))), section)
        return F.filter(cut, lambda s: s["content"] != "")

    # a document's lines stay in its row: none is shuffled
    heads = lambda lines: F.array_compact(F.transform(lines, lambda x, i: F.when(x.rlike(_HEADING), i)))
    cut = once(F.split(F.coalesce("text", F.lit("")), _LINE), lambda lines: once(heads(lines), lambda at: made(lines, at)))
    return docs.select("document_id", F.posexplode(cut).alias("order_index", "s")).select("document_id", "order_index", "s.title", "s.content")


def markdown_titles(docs: DataFrame) -> DataFrame:
    """(document_id, title): the hint, else the first heading, else a default."""
    return docs.select("document_id", F.coalesce(F.nullif("title_hint", F.lit("")), first_heading(F.col("text"))).alias("title"))


def first_heading(text):
    """The first heading of a text, else a default."""
    first = F.regexp_extract(text, r"(?m)^#{1,6}(?U:\s+)(.*)$", 1)
    return F.coalesce(F.nullif(_trim(first), F.lit("")), F.lit("Untitled Document"))


def csv_sections(docs: DataFrame) -> DataFrame:
    """(document_id, order_index, title, content): a section a row, `column: value` lines, titled by the first column. Fields
    may hold line ends, so a text is read as a whole; one without a header gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, order, titles, contents = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = csv.reader(io.StringIO(text or ""))
                header = next(table, [])
                full = (row for row in table if row)
                for n, row in enumerate(full if header else ()):
                    cells = dict(zip(header, [*row, *[None] * (len(header) - len(row))]))
                    ids.append(i)
                    order.append(n)
                    titles.append(cells[header[0]] or f"Row {n + 1}")
                    contents.append("\n".join(f"{k}: {v}" for k, v in cells.items() if k))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(order, pa.int32()), pa.array(titles, pa.string()), pa.array(contents, pa.string())], names=["document_id", "order_index", "title", "content"])

    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", "text").mapInArrow(run, f"document_id {kind}, order_index int, title string, content string")


#: The types of documents that can be parsed.
TYPES = ("openapi", "markdown", "csv")


def routed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, rejected) of docs (document_id, text, source_url[, doc_type]): those a parser takes, with doc_type, given or found
    by the text; and (document_id, code, message) of the others."""
    rows = marked(docs)
    return rows.where("message is null").drop("message"), rows.where("message is not null").select("document_id", F.lit("parser_error").alias("code"), "message")


def marked(docs: DataFrame) -> DataFrame:
    """docs (document_id, text, source_url[, doc_type]) with doc_type, and why no parser takes a document, or null, as message."""
    given = F.col("doc_type") if "doc_type" in docs.columns else F.lit(None).cast("string")
    typed = docs.withColumn("doc_type", F.coalesce(F.nullif(given, F.lit("")), doc_type(F.col("text"), F.col("source_url"))))
    text = F.coalesce("text", F.lit(""))
    empty = ~text.rlike(r"(?U)\S")
    own = typed.withColumn("flavour", openapi.flavour(text)).withColumn("paths", openapi.member(text, "paths").startswith("{"))
    message = (
        F.when(~F.col("doc_type").isin(*TYPES), F.concat(F.lit("unsupported doc_type: "), "doc_type"))
        .when(empty, "empty document")
        .when((F.col("doc_type") == "csv") & (_trim(F.substring_index(text, "\n", 1)) == ""), "csv document has no header row")
        .when((F.col("doc_type") == "openapi") & ~text.rlike(r"^\s*\{"), "document must be a mapping at top level")
        .when((F.col("doc_type") == "openapi") & F.col("flavour").isNull(), "unsupported OpenAPI/Swagger version")
        .when((F.col("doc_type") == "openapi") & ~F.coalesce("paths", F.lit(False)), "document is missing `paths`")
    )
    return own.withColumn("message", message).drop("flavour", "paths")


def sections(docs: DataFrame) -> DataFrame:
    """Sections of documents of the text types; docs: (document_id, text, source_url[, doc_type])."""
    typed = docs if "doc_type" in docs.columns else docs.withColumn("doc_type", doc_type(F.col("text"), F.col("source_url")))
    return markdown_sections(typed.where("doc_type = 'markdown'")).unionByName(csv_sections(typed.where("doc_type = 'csv'")))
