"""Files as a remote drive delivers them, to texts: which type is read how, how large it may be, and where a text is cut."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.error import URLError
from urllib.request import Request, urlopen

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from . import office

#: Types that the drive exports as text, and types that are files with text in them.
NATIVE = "application/vnd.google-apps."
EXPORTS = {NATIVE + "document": "text/plain", NATIVE + "spreadsheet": "text/csv", NATIVE + "presentation": "text/plain"}
BINARY = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
}
MAX_CHARS, MAX_BYTES = 200_000, 50_000_000


def _mapped(values: dict[str, str], key: str):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col(key))


def export_types(files: DataFrame) -> DataFrame:
    """Files (mime_type, ...) with export_as: the type a native file is to be exported as; null for others, and for native
    ones that have no text."""
    return files.withColumn("export_as", _mapped(EXPORTS, "mime_type"))


def texts(files: DataFrame, max_chars: int = MAX_CHARS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(external_id, text, truncated, status, message) of files (external_id, mime_type, content), content being what was exported or
    downloaded. NUL is left out; a text of exactly max_chars isn't cut. A file that can't be read has no text, and a
    message; it concerns no other file."""
    kind = _mapped(BINARY, "mime_type")
    native, plain = F.col("mime_type").startswith(NATIVE), F.col("mime_type").startswith("text/")
    marked = files.select("external_id", "mime_type", "content", kind.alias("kind")).withColumn(
        "message",
        F.when(F.coalesce("external_id", F.lit("")) == "", "file id must not be empty")
        .when(F.col("content").isNull(), "file could not be read")
        .when(native & _mapped(EXPORTS, "mime_type").isNull(), F.concat(F.lit("unsupported native type for text export: "), "mime_type"))
        .when(~native & ~plain & F.col("kind").isNull(), F.concat(F.lit("unsupported binary type: "), F.coalesce("mime_type", F.lit(""))))
        .when(F.col("kind").isNotNull() & (F.octet_length("content") > max_bytes), F.concat(F.lit("file exceeds download size limit: "), F.octet_length("content").cast("string"))),
    )
    good = marked.where("message is null")
    said = good.where("kind is null").select("external_id", F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("string").alias("message"))
    packed = good.where("kind is not null").select(F.concat("external_id", F.lit("."), "kind").alias("path"), "content")
    read = office.texts(packed).select(F.regexp_replace("path", r"\.[^.]*$", "").alias("external_id"), "text", F.when(F.col("text").isNull(), F.concat(F.lit("failed to parse as "), "doc_type")).alias("message"))
    rows = said.unionByName(read).unionByName(marked.where("message is not null").select("external_id", F.lit(None).cast("string").alias("text"), "message"))
    cut = F.when(F.col("message").isNull(), clean_text(F.substring("text", 1, max_chars)))
    return rows.select("external_id", cut.alias("text"), F.coalesce(F.col("message").isNull() & (F.length("text") > max_chars), F.lit(False)).alias("truncated"), F.when(F.col("message").isNull(), "ok").otherwise("failed").alias("status"), "message")


def from_urls(rows: DataFrame, timeout: float = 10.0, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(document_id, source_url, text, status, code, message) of rows (document_id, source_url): each url is read once by the task
    that holds it. What can't be read, or is too large, fails for its own row only."""

    def read(url: str | None) -> tuple[str | None, str | None]:
        try:
            if not (url or "").startswith(("http://", "https://")):
                return None, f"no http address: {url}"
            with urlopen(Request(url), timeout=timeout) as answer:  # noqa: S310  the scheme is checked above
                raw = answer.read(max_bytes + 1)
                if len(raw) > max_bytes:
                    return None, f"{url} exceeds download size limit"
                return raw.decode(answer.headers.get_content_charset() or "utf-8", "replace"), None
        except (URLError, OSError, ValueError, LookupError) as e:
            return None, f"failed to fetch {url}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own = batch.slice(at, 1)
                text, message = read(own.column(1)[0].as_py())
                status, code = ("ok", None) if message is None else ("failed", "integration_error")
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *[pa.array([x], pa.string()) for x in (text, status, code, message)]], names=["document_id", "source_url", "text", "status", "code", "message"])

    kind = rows.schema["document_id"].dataType.simpleString()
    return rows.select("document_id", "source_url").mapInArrow(run, f"document_id {kind}, source_url string, text string, status string, code string, message string")
