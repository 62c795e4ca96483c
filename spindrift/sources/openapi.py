"""OpenAPI 3.x and Swagger 2.0 documents to tables, with JSON functions: `from_json` to ordered maps, exploded twice.

In: rows (document_id, text) of JSON; YAML is turned into JSON first where its library is installed. A text that is
no such document gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the verbs of a path.
VERBS = ["get", "put", "post", "delete", "options", "head", "patch", "trace"]
_MAP = "map<string,string>"
_ITEMS = "array<string>"


def as_map(json_text: Column) -> Column:
    """The members of a JSON object in order; null if it is none."""
    return F.from_json(json_text, _MAP)


def as_items(json_text: Column) -> Column:
    return F.coalesce(F.from_json(json_text, _ITEMS), F.array().cast(_ITEMS))


def member(json_text: Column, *path: str) -> Column:
    """A member by its names, as JSON text or, for a string, its characters."""
    return F.get_json_object(json_text, "$" + "".join(f"['{p}']" for p in path))


def yaml_as_json(docs: DataFrame) -> DataFrame:
    """Docs with texts that are YAML mappings as JSON; what can't be read becomes null. sections.routed() says why."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            import yaml
        except ImportError:
            yaml = None
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                try:
                    data = json.loads(text)
                except (TypeError, ValueError):
                    try:
                        data = yaml.safe_load(text) if yaml and text else None
                    except Exception:  # noqa: BLE001  the library's errors have no common class without it
                        data = None
                out.append(json.dumps(data, ensure_ascii=False, default=str) if isinstance(data, dict) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["document_id", "text"])

    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", "text").mapInArrow(run, f"document_id {kind}, text string")


def flavour(text: Column) -> Column:
    """openapi3 or swagger2, by the version a document states; else null."""
    return F.when(member(text, "openapi").startswith("3."), "openapi3").when(member(text, "swagger").startswith("2."), "swagger2")


def headers(docs: DataFrame) -> DataFrame:
    """(document_id, flavour, title, version, text) of the documents that are OpenAPI 3 or Swagger 2."""
    named = lambda x, default: F.coalesce(F.nullif(member(F.col("text"), "info", x), F.lit("")), F.lit(default))
    rows = docs.select("document_id", flavour(F.col("text")).alias("flavour"), named("title", "Untitled API").alias("title"), named("version", "unknown").alias("version"), "text")
    return rows.where("flavour is not null")


def _reference(schema: Column) -> Column:
    return F.replace(member(schema, "$ref"), F.lit("#/definitions/"), F.lit("#/components/schemas/"))


def _parameter(raw: Column) -> Column:
    own = F.map_filter(as_map(raw), lambda k, v: k.isin("type", "format", "items", "enum", "example"))
    inline = F.when(F.size(own) > 0, F.to_json(F.transform_values(own, lambda k, v: v))).otherwise("{}")
    schema = F.coalesce(F.when(member(raw, "schema").startswith("{"), member(raw, "schema")), inline)
    return F.struct(
        F.coalesce(member(raw, "name"), F.lit("")).alias("name"),
        F.coalesce(member(raw, "in"), F.lit("query")).alias("location"),
        F.coalesce(member(raw, "required") == "true", F.lit(False)).alias("required"),
        schema.alias("schema"),
        F.coalesce(member(raw, "description"), F.lit("")).alias("description"),
        _reference(schema).alias("schema_ref"),
    )


def _first_media(content: Column) -> Column:
    return F.get(F.map_entries(as_map(content)), F.lit(0))


def endpoints(docs: DataFrame) -> DataFrame:
    """(document_id, endpoint_id, idx, method, path, operation_id, summary, description, tags, parameters, request_body,
    responses), in the documents' order."""
    # what is read of the whole text is read once a document: a row a path or verb doesn't carry the text
    media_type = lambda name: F.coalesce(F.get(as_items(member(F.col("text"), name)), F.lit(0)), F.lit("application/json")).alias(name)
    head = headers(docs).select("document_id", "flavour", media_type("consumes"), media_type("produces"), member(F.col("text"), "paths").alias("paths"))
    paths = head.select("document_id", "flavour", "consumes", "produces", F.posexplode(as_map(F.col("paths"))).alias("at", "path", "item")).repartition("document_id", "at")
    shared = F.when(F.col("flavour") == "openapi3", as_items(member(F.col("item"), "parameters"))).otherwise(F.array().cast(_ITEMS))
    verbs = paths.select("document_id", "flavour", "consumes", "produces", "at", "path", shared.alias("shared"), F.posexplode(as_map(F.col("item"))).alias("verb_at", "verb", "op"))
    verbs = verbs.where(F.lower("verb").isin(VERBS) & F.col("op").startswith("{"))
    old = F.col("flavour") == "swagger2"
    listed = F.concat("shared", as_items(member(F.col("op"), "parameters")))
    in_body = F.get(F.filter(listed, lambda p: member(p, "in") == "body"), F.lit(0))
    consumes, produces = F.col("consumes"), F.col("produces")
    body = lambda kind, schema, required, example: F.struct(kind.alias("content_type"), F.coalesce(schema, F.lit("{}")).alias("schema"), F.coalesce(required == "true", F.lit(False)).alias("required"), example.alias("example"), _reference(schema).alias("schema_ref"))
    media = _first_media(member(F.col("op"), "requestBody", "content"))
    some = F.get(F.map_values(as_map(member(media["value"], "examples"))), F.lit(0))
    new_body = F.when(media.isNotNull(), body(media["key"], member(media["value"], "schema"), member(F.col("op"), "requestBody", "required"), F.coalesce(member(media["value"], "example"), member(some, "value"))))
    old_body = F.when(in_body.isNotNull(), body(consumes, member(in_body, "schema"), member(in_body, "required"), member(in_body, "example")))

    def response(entry: Column) -> Column:
        own = _first_media(member(entry["value"], "content"))
        schema = F.when(old, member(entry["value"], "schema")).otherwise(member(own["value"], "schema"))
        kind = F.when(old, produces).otherwise(F.coalesce(own["key"], F.lit("application/json")))
        example = F.when(old, member(entry["value"], "example")).otherwise(member(own["value"], "example"))
        return F.struct(entry["key"].alias("status_code"), kind.alias("content_type"), F.coalesce(schema, F.lit("{}")).alias("schema"), F.coalesce(member(entry["value"], "description"), F.lit("")).alias("description"), example.alias("example"), _reference(schema).alias("schema_ref"))

    answers = F.coalesce(as_map(member(F.col("op"), "responses")), F.create_map().cast(_MAP))
    rows = verbs.select(
        "document_id", "at", "verb_at", F.upper("verb").alias("method"), "path",
        member(F.col("op"), "operationId").alias("operation_id"),
        F.coalesce(member(F.col("op"), "summary"), F.lit("")).alias("summary"),
        F.coalesce(member(F.col("op"), "description"), F.lit("")).alias("description"),
        F.filter(as_items(member(F.col("op"), "tags")), lambda t: t.isNotNull()).alias("tags"),
        F.transform(F.filter(listed, lambda p: ~(old & (F.coalesce(member(p, "in"), F.lit("")) == "body"))), _parameter).alias("parameters"),
        F.when(old, old_body).otherwise(new_body).alias("request_body"),
        F.array_sort(F.transform(F.map_entries(answers), response), lambda a, b: F.when(a["status_code"] < b["status_code"], -1).when(a["status_code"] > b["status_code"], 1).otherwise(0)).alias("responses"),
    )
    from pyspark.sql import Window as W

    numbered = rows.withColumn("idx", F.row_number().over(W.partitionBy("document_id").orderBy("at", "verb_at")) - 1)
    own_id = F.concat(F.col("document_id").cast("string"), F.lit(":ep:"), F.substring(F.sha1(F.concat_ws(":", F.col("document_id").cast("string"), "method", "path", F.col("idx").cast("string"))), 1, 16))
    return numbered.select("document_id", own_id.alias("endpoint_id"), "idx", "method", "path", "operation_id", "summary", "description", "tags", "parameters", "request_body", "responses")


def schemas(docs: DataFrame) -> DataFrame:
    """(document_id, schema_id, idx, name, description, json_schema) of component schemas or definitions."""
    head = headers(docs)
    held = F.when(F.col("flavour") == "openapi3", member(F.col("text"), "components", "schemas")).otherwise(member(F.col("text"), "definitions"))
    rows = head.select("document_id", F.posexplode(as_map(held)).alias("idx", "name", "json_schema"))
    return rows.select("document_id", F.concat(F.col("document_id").cast("string"), F.lit(":schema:"), F.col("idx").cast("string")).alias("schema_id"), "idx", "name", F.coalesce(member(F.col("json_schema"), "description"), F.lit("")).alias("description"), "json_schema")
