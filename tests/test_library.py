"""A library from registration to search, and the batch commands."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spindrift import __main__ as batch
from spindrift import storage
from spindrift.errors import DocumentNotFound, EndpointNotFound, NotConfigured, ValidationError, payload
from spindrift.plans.ingest import _meta_id
from spindrift.plans.library import Library
from spindrift.plans.search import Scope
from spindrift.sources.store import Store

NOW = datetime(2024, 3, 1)
API = json.dumps({"openapi": "3.0.0", "info": {"title": "Shop", "version": "2"}, "paths": {"/carts": {"get": {"operationId": "listCarts", "summary": "All carts", "tags": ["cart"], "responses": {"200": {"description": "ok"}}}, "post": {"operationId": "openCart", "summary": "Open a cart", "tags": ["cart", "write"]}}}, "components": {"schemas": {"Cart": {"type": "object", "properties": {"id": {"type": "integer"}}}}}})


@pytest.fixture(scope="module")
def library(spark):
    tokens = spark.createDataFrame([("drive", "t"), ("notion", "")], "source_type string, token string")
    lib = Library(Store(spark, storage.fresh(spark, "library")), tokens, batch.hashed(32), "hash-32")
    docs = spark.createDataFrame([("a", "p", None, API, None), ("b", "q", None, API.replace("cart", "order"), None)], "document_id string, project string, source_url string, text string, doc_type string")
    assert lib.register(docs, "r1", NOW) == {"registered": 2, "total": 2}
    lib.set_mappings(spark.createDataFrame([("p", "drive", "f1", None), ("p", "notion", "n1", "page")], "project string, source_type string, location string, kind string"))
    files = spark.createDataFrame([("p", "drive", "d1", 0, "Payment guide v3", "u1", NOW), ("p", "drive", "d2", 1, "Holidays", "u2", NOW), ("p", "notion", "n1", 2, "unread", "u3", NOW)], "project string, source string, external_id string, ordinal int, title string, url string, modified_at timestamp")
    ids = files.withColumn("document_id", _meta_id())
    bodies = ids.select("document_id", F.when(F.col("external_id") == "d1", "# Refunds\nhow to refund a payment\n# Cards\ncards").otherwise("closed in May").alias("text"), F.lit("ok").alias("status"))
    done = lib.refresh_index(files, "r2", NOW, bodies)
    assert (done["added"], done["fetched_bodies"]) == (2, 2) and done["embedded"] > 0  # without a token, notion isn't read
    return lib


def test_reads(spark, library):
    assert [(r.document_id, r.n_endpoints) for r in library.list_documents("p").where("doc_type = 'openapi'").collect()] == [("a", 2)]
    assert {r.tag: r.n for r in library.list_tags(project="p").collect()} == {"cart": 2, "write": 1}
    assert library.raw(spark.createDataFrame([("a",), ("z",)], "document_id string")).where("code = 'document_not_found'").count() == 1
    assert {r.type for r in library.resolve_refs(spark.createDataFrame([("#/components/schemas/Cart",)], "ref string")).collect()} == {"integer"}
    one = library.store.snapshot().table("endpoints").where("operation_id = 'openCart' and document_id = 'a'").first().endpoint_id
    found = library.get_endpoint(one, example=True).first()
    assert found.example_code.startswith("curl -X POST") and [r.path for r in found.related_endpoints] == ["/carts"]
    with pytest.raises(EndpointNotFound) as e:
        library.get_endpoint("none")
    assert payload(e.value) == {"error": True, "code": "endpoint_not_found", "message": "endpoint not found: none"}
    assert library.get_document("drive", "d2").first().text == "closed in May"
    with pytest.raises(DocumentNotFound):
        library.get_document("drive", "d9")
    assert {r.status for r in library.history().collect()} == {"registered"}


def test_search(spark, library):
    queries = spark.createDataFrame([(1, "open cart", ["order"]), (2, "GET /carts", None)], "query_id int, text string, variants array<string>")
    rows = library.search_endpoints(queries, top_k=3, scope=Scope(project="p")).collect()
    assert {r.project for r in rows} == {"p"}
    best = {r.query_id: r for r in rows if r["rank"] == 1}
    assert (best["1"].method, best["1"].match_type) == ("POST", "both") and (best["2"].method, best["2"].match_type) == ("GET", "exact")
    both = library.search_endpoints(queries.where("query_id = 2"), top_k=3).collect()
    assert [r.project for r in both if r.match_type == "exact"] == ["p"]
    words = spark.createDataFrame([(7, "refund payment")], "query_id int, text string")
    hit = library.search_documents(words, top_k=2).orderBy("rank").first()
    assert (hit.title, hit.version, hit.source) == ("Payment guide v3", "v3", "drive") and hit.snippet.startswith("# Refunds")
    fetched = library.search_documents(words, top_k=2, strategy="fetch", source="drive").collect()
    assert [(r.title, r.url) for r in fetched] == [("Payment guide v3", "u1")]
    with pytest.raises(NotConfigured):
        library.search_documents(words, source="notion")
    with pytest.raises(ValidationError):
        library.search_endpoints(queries, top_k=0)


def test_mappings(spark, library):
    asked = spark.createDataFrame([("p", "notion"), ("zz", "drive")], "project string, source_type string")
    assert library.remove_mappings(asked) == 1 and library.remove_mappings(asked) == 0
    assert [r.location for r in library.mappings().collect()] == ["f1"]


def test_batch(spark, tmp_path):
    store = storage.fresh(spark, "batch")
    raw = spark.createDataFrame([("a", "p", None, "# One\n" + "w " * 600, "markdown"), ("b", "p", None, "x", "odd")], "document_id string, project string, source_url string, text string, doc_type string")
    raw.write.parquet(f"file://{tmp_path}/raw")
    call = lambda *a: batch.run(spark, [a[0], "--store", store, *a[1:]])
    assert call("ingest", "--in", f"file://{tmp_path}/raw", "--run", "1") == {"registered": 1, "failed": 1, "total": 2}
    assert call("reembed", "--run", "2", "--dim", "8")["embedded"] == 2 and call("reembed", "--run", "3", "--dim", "8")["embedded"] == 0
    assert call("overflow", "--out", f"file://{tmp_path}/over") == {"types": 1}
    assert call("compact")["version"] > 1 and len(call("vacuum")["versions"]) == 1
