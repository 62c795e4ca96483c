"""Chunks: texts of endpoints, schemas and sections, long sections split under a token budget, hash embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..sources.openapi import as_map, member
from .snippets import SPACE

TOKEN_LIMIT = 480
#: Fixed value: where a sentence may end.
BOUNDARY = r"(?U)(?<=[.!?。])[\s\x1C-\x1F]+|\n"


def _names(json_schema):
    return F.array_join(F.array_sort(F.map_keys(as_map(member(json_schema, "properties")))), ", ")


def _line(label: str, value):
    return F.when(value != "", F.concat(F.lit(label), value))


def endpoint_text():
    """The text of an endpoint row, fields that identify it first."""
    head = F.concat(F.lit("["), F.col("method"), F.lit("] "), F.col("path"), F.when(F.col("summary") != "", F.concat(F.lit(" — "), F.col("summary"))).otherwise(""))
    params = F.array_join(F.transform("parameters", lambda p: F.concat(p["name"], F.lit("("), p["location"], F.when(p["required"], ",required)").otherwise(",optional)"))), ", ")
    return F.concat_ws(
        "\n",
        F.rtrim(head),
        _line("OperationId: ", F.coalesce("operation_id", F.lit(""))),
        _line("Params: ", params),
        _line("Body: ", F.coalesce(_names(F.col("request_body.schema")), F.lit(""))),
        _line("Tags: ", F.array_join("tags", ", ")),
        _line("", F.col("description")),
        _line("Responses: ", F.array_join(F.transform("responses", lambda r: r["status_code"]), ", ")),
    )


def tagged_endpoint_text():
    """endpoint_text() after its first tag: a variant that was tried for retrieval."""
    return F.concat(F.when(F.size("tags") > 0, F.concat(F.lit("Tag: "), F.get("tags", F.lit(0)), F.lit("\n"))).otherwise(""), endpoint_text())


def schema_text():
    return F.concat_ws("\n", F.concat(F.lit("Schema: "), F.col("name")), _line("", F.col("description")), _line("Properties: ", F.coalesce(_names(F.col("json_schema")), F.lit(""))))


def section_text():
    return F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("# "), F.col("title"), F.lit("\n"), F.col("content"))).otherwise(F.col("content"))


def word_count(text: Column) -> Column:
    """The default count of tokens."""
    # split() would compile its pattern anew for every sentence
    return F.regexp_count(text, F.lit(SPACE.replace("[", "[^", 1) + "++"))


def _packed(parts: Column, glue: str, budget: Column, finer: Callable[[Column], Column]) -> Column:
    """Fills pieces up to a budget of words, joined by white space; a part over the budget goes to the next finer cut. One fold over
    the parts: what is done, what is held and its words, and whether nothing is held."""
    none = F.array().cast("array<string>")
    counted = F.transform(parts, lambda p: F.struct(p.alias("text"), word_count(p).alias("n")))

    def state(done: Column, held: Column, n: Column, empty: bool) -> Column:
        return F.struct(done.alias("done"), held.alias("held"), n.alias("n"), F.lit(empty).alias("empty"))

    def closed(s: Column) -> Column:
        return F.when(s["empty"], s["done"]).otherwise(F.concat(s["done"], F.array(s["held"])))

    def step(s: Column, part: Column) -> Column:
        return (
            F.when(part["n"] > budget, state(F.concat(closed(s), finer(part["text"])), F.lit(""), F.lit(0), True))
            .when(s["empty"] | (s["n"] + part["n"] > budget), state(closed(s), part["text"], part["n"], False))
            .otherwise(state(s["done"], F.concat(s["held"], F.lit(glue), part["text"]), s["n"] + part["n"], False))
        )

    return F.aggregate(counted, state(none, F.lit(""), F.lit(0), True), step, closed)


def _cut(text: Column, budget: Column) -> Column:
    """Pieces of so many words, with the white space after each."""
    own = F.regexp_extract_all(text, F.lit(SPACE + "*+" + SPACE.replace("[", "[^", 1).replace("(?U)", "") + "++" + SPACE.replace("(?U)", "") + "*+"), F.lit(0))
    starts = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / budget).cast("int"))
    return F.transform(starts, lambda i: F.array_join(F.slice(own, i * budget + 1, budget), ""))


def section_parts(title: Column, content: Column, limit: int) -> Column:
    """Texts of a section that hold up to `limit` words; each begins with the title. Paragraphs are put together, of a
    longer paragraph sentences, and a longer sentence is cut between words."""
    head = F.when(title != "", F.concat(F.lit("# "), title, F.lit("\n"))).otherwise("")

    def parts(own: Column) -> Column:
        budget = own["budget"]
        sentences = lambda p: _packed(F.filter(F.split(p, BOUNDARY), lambda x: x != ""), " ", budget, lambda x: _cut(x, budget))
        made = _packed(F.split(own["content"], "\n\n"), "\n\n", budget, sentences)
        return F.when(own["n"] <= limit, F.array(F.concat(own["head"], own["content"]))).otherwise(F.transform(made, lambda x: F.concat(own["head"], x)))

    # within one array, so that the title's words are counted once a section, not once a sentence
    own = F.struct(head.alias("head"), content.alias("content"), F.greatest(F.lit(1), F.lit(limit) - word_count(head)).alias("budget"), (word_count(head) + word_count(content)).alias("n"))
    return F.get(F.transform(F.array(own), parts), F.lit(0))


def split_sections(sections: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Sections (..., title, content) with their parts: (..., part, text)."""
    keep = [c for c in sections.columns if c not in ("title", "content")]
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return sections.select(*keep, F.posexplode(section_parts(text("title"), text("content"), limit)).alias("part", "text"))


def build_chunks(endpoints: DataFrame, schemas: DataFrame, sections: DataFrame, limit: int | None = TOKEN_LIMIT, tagged: bool = False) -> DataFrame:
    """(document_id, chunk_id, chunk_type, ref_id, text): endpoints, then schemas, then sections (document_id, order_index,
    title, content), numbered in this order within a document; sections split unless limit is None; endpoints after their first
    tag if tagged."""
    from pyspark.sql import Window as W

    named = sections.withColumn("ref_id", F.concat(F.col("document_id").cast("string"), F.lit(":section:"), F.col("order_index").cast("string")))
    parts = split_sections(named, limit) if limit else named.select("document_id", "order_index", "ref_id", F.lit(0).alias("part"), section_text().alias("text"))
    rows = (
        endpoints.select("document_id", F.lit(0).alias("kind"), F.col("idx").cast("int").alias("at"), F.lit(0).alias("part"), F.col("endpoint_id").alias("ref_id"), (tagged_endpoint_text() if tagged else endpoint_text()).alias("text"))
        .union(schemas.select("document_id", F.lit(1), F.col("idx").cast("int"), F.lit(0), F.col("schema_id"), schema_text()))
        .union(parts.select("document_id", F.lit(2), F.col("order_index").cast("int"), "part", "ref_id", "text"))
    )
    number = F.row_number().over(W.partitionBy("document_id").orderBy("kind", "at", "part")) - 1
    kinds = F.get(F.array(F.lit("endpoint"), F.lit("schema"), F.lit("section")), F.col("kind"))
    return rows.withColumn("n", number).select("document_id", F.concat(F.col("document_id").cast("string"), F.lit(":chunk:"), F.col("n").cast("string")).alias("chunk_id"), kinds.alias("chunk_type"), "ref_id", "text")


def hash_embedding(docs: DataFrame, key: str, text: str = "text", dim: int = 256) -> DataFrame:
    """(key, bucket, value), the parts of unit vectors that aren't zero: signed counts of terms by hash bucket. A text
    without terms has one fixed bucket."""
    if dim <= 0:
        raise ValueError("dim must be positive")
    rows = docs.select(F.col(key).alias("key"), X.terms(text, X.ASCII_TERM).alias("terms"))
    some = rows.where(F.size("terms") > 0).select("key", F.explode("terms").alias("term")).groupBy("key", "term").agg(F.count("*").alias("n"))
    parts = some.groupBy("key", V.hash_bucket(F.col("term"), dim).alias("bucket")).agg(F.sum(F.col("n") * V.hash_sign(F.col("term"))).alias("v")).where("v <> 0")
    length = parts.groupBy("key").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("length"))
    whole = parts.join(length, "key").select("key", "bucket", (F.col("v") / F.col("length")).alias("value"))
    # a text without terms has the remainder of a whole digest, not of its first bytes
    bucket = int(hashlib.sha256(b"__empty__").hexdigest(), 16) % dim
    return whole.union(rows.where(F.size("terms") == 0).select("key", F.lit(bucket).cast("long").alias("bucket"), F.lit(1.0).alias("value")))


def overflow(sections: DataFrame, by: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """(by, n_over, max_tokens) of sections (by, text) with more words than the limit."""
    n = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    return sections.select(by, n.alias("n")).where(F.col("n") > limit).groupBy(by).agg(F.count("*").alias("n_over"), F.max("n").cast("long").alias("max_tokens"))
