"""WARC archives: write records, find their borders again by boundary-chain verification, read them.

Writing: one record a page; of pages with equal payloads that of the largest id is a response, the others are
revisits that refer to it. Spark's text writer puts the records into files, with the two line ends that close a
record as its line separator.

Reading: an archive is cut at every occurrence of the version line, wherever a split of the file begins. A piece
is a candidate record: its place in the file and its Content-Length give the place of its successor. Payloads
may hold version lines, or whole records, of their own. Only candidates that are reachable from the file's
start count: neighbours whose links fit are contracted to chains within a split, and pointer jumping over the
chains' exits finds those on the path, in a logarithmic number of rounds. A record whose payload holds a
version line is put together again from its pieces.

Results in odd cases: a null html is an empty payload; a null url writes no target; rows that repeat the largest
id of a payload are all responses; a null page_id is written and read as null and is referred to only if all of
its payload's ids are null. An archive that doesn't begin with a record yields none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh_path, joined_if_small, stored

MAGIC, CRLF, CLOSE = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
#: Digests that occur more than once are broadcast up to so many.
BROADCAST_ROWS = 200_000
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


def base32_sha1(data: Column) -> Column:
    """SHA-1 in base 32: 40 bits of it at a time, eight digits each."""
    hex_ = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hex_, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _DIGITS, BASE32)


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(record): the text of a WARC record, without its closing line ends, for each of pages (page_id, url, html)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), base32_sha1(payload.cast("binary")).alias("digest"), F.octet_length(payload).alias("bytes"))
    large = rows.where(F.col("bytes") >= min_bytes)
    shared = stored(large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "digests")
    rows = joined_if_small(rows, shared, "digest", "left", shared.count(), BROADCAST_ROWS)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.col("bytes") >= min_bytes)
    http = F.concat(F.lit(HTTP), F.col("bytes").cast("string"), F.lit(CLOSE))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "_")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("first"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
    )
    return rows.select(F.concat(head, block).alias("record"))


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    records(pages, min_bytes).write.mode("overwrite").option("lineSep", CLOSE).text(path)


def _field(head: Column, name: str) -> Column:
    found = F.regexp_extract(head, rf"(?mi)^{name}:[ \t]*([^\r\n]*)", 1)
    return F.when(found != "", found)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, split, row, piece): archives cut at the version line, in order of row within a split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"), F.col("value").alias("piece")
    )


def parsed(cut: DataFrame, payloads: bool = False) -> DataFrame:
    """Pieces with what their heads say. whole: the record ends where the piece does. payloads: with url and payload."""
    head = F.substring_index("piece", CLOSE, 1)
    rows = cut.withColumn("head", head).withColumn("bytes", F.octet_length("piece"))
    rows = rows.withColumn("length", _field(F.col("head"), "Content-Length").try_cast("long")).withColumn("head_bytes", F.octet_length("head") + 4)
    block = F.substring(F.col("piece").cast("binary"), F.col("head_bytes") + 1, F.col("length").cast("int"))
    # the HTTP head, however long; a character for each byte
    http = F.substring_index(F.decode(block, "ISO-8859-1"), CLOSE, 1)
    at = F.length(http) + 1
    payload = F.substring(block, at + 4, 2147483647)
    kind = F.lower(_field(F.col("head"), "WARC-Type"))
    span = F.col("head_bytes") + F.col("length") + 4
    urn = lambda name: F.regexp_extract(F.coalesce(_field(F.col("head"), name), F.lit("")), r"^<urn:page:(-?\d+)>", 1).try_cast("long")
    return rows.select(
        "file", "split", "row", "bytes", "length", kind.alias("record_type"),
        F.when(F.col("bytes") >= F.col("head_bytes"), span).alias("span"),
        urn("WARC-Record-ID").alias("page_id"), urn("WARC-Refers-To").alias("refers_to"),
        F.regexp_extract(F.coalesce(_field(F.col("head"), "WARC-Payload-Digest"), F.lit("")), r"^sha1:(\w+)$", 1).alias("digest"),
        base32_sha1(payload).alias("own_digest"), F.octet_length(payload).cast("long").alias("own_bytes"),
        *([_field(F.col("head"), "WARC-Target-URI").alias("url"), payload.alias("payload")] if payloads else []),
        F.regexp_extract(http, r"(?i)\r\nContent-Length:[ \t]*(\d+)", 1).try_cast("long").alias("said_bytes"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """Rows (file, split, row, bytes) with `at`, where the piece begins: behind a version line, but for the file's first."""
    size = F.col("bytes") + len(MAGIC)
    totals = rows.groupBy("file", "split").agg(F.sum(size).alias("total"))
    before = lambda *key: W.partitionBy(*key[:-1]).orderBy(key[-1]).rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select("file", "split", F.coalesce(F.sum("total").over(before("file", "split")), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum(size).over(before("file", "split", "row")), F.lit(0))
    return rows.withColumn("own", own).join(bases, ["file", "split"]).withColumn("at", F.col("base") + F.col("own")).drop("base", "own")


def reachable(found: DataFrame) -> DataFrame:
    """(file, at, next) of the candidates (file, split, at, span) on the chain of their file's start; `at` is behind
    the version line, `next` is the successor's."""
    # without a length or a whole head a candidate ends its chain
    linked = found.select("file", "split", "at", (F.col("at") + F.col("span") + len(MAGIC)).alias("next"))
    w = W.partitionBy("file", "split").orderBy("at")
    fits = F.lag("next").over(w).eqNullSafe(F.col("at")) & F.col("next").isNotNull()
    chained = linked.withColumn("new", F.when(fits, 0).otherwise(1)).withColumn("chain", F.max(F.when(F.col("new") == 1, F.col("at"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    chained = stored(chained.select("file", "at", "next", "chain"), "chains")
    # a chain leads to the chain in which its last successor lies; it is entered there, perhaps in its middle
    exits = chained.groupBy("file", "chain").agg(F.max_by("next", "at").alias("exit"))
    places = chained.select("file", F.col("at").alias("exit"), F.col("chain").alias("to"))
    jumps = stored(exits.join(places, ["file", "exit"]).select("file", "chain", "exit", "to"), "jumps")
    first = chained.where(F.col("at") == len(MAGIC)).select("file", "chain", F.col("at").alias("entry"))
    reached, leap = stored(first, "reached"), jumps
    while True:
        onward = reached.join(leap, ["file", "chain"]).select("file", F.col("to").alias("chain"), F.col("exit").alias("entry"))
        more = stored(onward.join(reached, ["file", "chain"], "left_anti").distinct(), "reached")
        if more.isEmpty():
            break
        reached = reached.union(more)
        second = leap.select("file", F.col("chain").alias("to"), F.col("exit").alias("exit2"), F.col("to").alias("to2"))
        leap = stored(leap.join(second, ["file", "to"]).select("file", "chain", F.col("exit2").alias("exit"), F.col("to2").alias("to")), "jumps")
    return chained.join(reached, ["file", "chain"]).where(F.col("at") >= F.col("entry")).select("file", "at", "next")


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records of the archives in a folder; with payloads also
    (url, payload), the payload of a revisit being empty."""
    found = stored(placed(parsed(pieces(spark, path), payloads)), "pieces")
    on_path = stored(reachable(found.where("at > 0")), "path")
    kept = found.join(on_path, ["file", "at"])
    whole = F.col("bytes") == F.col("span")
    fields = ["page_id", "record_type", "refers_to", "digest", "own_digest", "own_bytes", "said_bytes", *(["url", "payload"] if payloads else [])]
    broken = stored(kept.where(~whole & F.col("span").isNotNull()).select("file", F.col("at").alias("begin"), "next"), "broken")
    rows = kept.where(whole).select(*fields)
    if n := broken.count():
        rows = rows.union(_rejoined(spark, path, broken, n, payloads).select(*fields))
    response = F.col("record_type") == "response"
    return rows.where(F.col("record_type").isin("response", "revisit")).select(
        "page_id",
        F.when(response, F.col("own_bytes")).otherwise(F.col("said_bytes")).alias("payload_bytes"),
        F.when(response, F.col("own_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(response, F.lit(None).cast("long")).otherwise(F.col("refers_to")).alias("refers_to"),
        *(["url", "payload"] if payloads else []),
    )


def _rejoined(spark: SparkSession, path: str, broken: DataFrame, n: int, payloads: bool = False) -> DataFrame:
    """Records (file, begin, next) whose payloads hold version lines, parsed from their pieces put together."""
    cut = pieces(spark, path).withColumn("bytes", F.octet_length("piece"))
    places = placed(cut.select("file", "split", "row", "bytes")).select("file", "split", "row", "at")
    inside = joined_if_small(places, broken, "file", "inner", n, BROADCAST_ROWS).where((F.col("at") >= F.col("begin")) & (F.col("at") < F.col("next")))
    inside = stored(inside.select("file", "split", "row", "at", "begin"), "inside")
    own = joined_if_small(cut.drop("bytes"), inside, ["file", "split", "row"], "inner", inside.count(), BROADCAST_ROWS)
    # as many pieces as a record has
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x.piece), MAGIC)
    return parsed(own.groupBy("file", F.col("begin").alias("row")).agg(text.alias("piece")).withColumn("split", F.lit(0).cast("long")), payloads)


def roundtrip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    path = fresh_path(pages.sparkSession, "warc")
    write(pages, path, min_bytes)
    return read(pages.sparkSession, path)
