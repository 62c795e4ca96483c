"""Versions that come whole, batches that are counted once, and what refresh, ingest and embedding commit."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spindrift import storage
from spindrift.errors import Conflict, ValidationError
from spindrift.plans import ingest
from spindrift.sources.store import Store

NOW = datetime(2024, 3, 1)


@pytest.fixture()
def store(spark):
    return Store(spark, storage.fresh(spark, "store"))


def rows(spark, *values):
    return spark.createDataFrame(list(values), "document_id string, text string")


def held(snapshot, name="chunks"):
    return sorted(tuple(r) for r in snapshot.table(name).collect())


def test_versions(spark, store):
    first = store.commit({"chunks": rows(spark, ("a", "1"), ("a", "2"), ("b", "3"))}, {})
    pinned = store.snapshot()
    second = store.commit({"chunks": rows(spark, ("a", "new"))}, {"chunks": rows(spark, ("a", ""))})
    third = store.commit({}, {"chunks": rows(spark, ("b", ""))})
    assert (first.version, second.version, third.version) == (1, 2, 3) == tuple(store.versions())
    assert held(pinned) == [("a", "1"), ("a", "2"), ("b", "3")]  # a reader stays with its version
    assert held(store.snapshot(2)) == [("a", "new"), ("b", "3")] and held(store.snapshot()) == [("a", "new")]
    assert store.snapshot().table("chunks").columns == ["document_id", "text"]
    store.compact()
    store.vacuum()
    assert store.versions() == [4] and held(store.snapshot()) == [("a", "new")]
    store.commit({"chunks": rows(spark, ("a", "again"))}, {"chunks": rows(spark, ("a", ""))})
    assert held(store.snapshot()) == [("a", "again")]
    with pytest.raises(ValidationError):
        store.snapshot().table("nothing")
    with pytest.raises(ValidationError):
        store.commit({"chunks": rows(spark, ("a", "x")).withColumn("more", F.lit(1))}, {})


def test_a_failed_write_leaves_the_version_whole(spark, store):
    store.commit({"chunks": rows(spark, ("a", "1"), ("b", "2")), "documents": rows(spark, ("a", "d"))}, {})
    broken = rows(spark, ("a", "new"), ("c", "3")).withColumn("text", F.when(F.col("document_id") == "c", F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        store.commit({"documents": rows(spark, ("a", "new")), "chunks": broken}, {"chunks": rows(spark, ("a", "")), "documents": rows(spark, ("a", ""))})
    assert store.versions() == [1]
    assert held(store.snapshot()) == [("a", "1"), ("b", "2")] and held(store.snapshot(), "documents") == [("a", "d")]
    store.vacuum()
    assert held(store.snapshot()) == [("a", "1"), ("b", "2")]


def test_two_writers(spark, store):
    base = store.commit({"chunks": rows(spark, ("a", "1"))}, {})
    store.commit({"chunks": rows(spark, ("b", "mine"))}, {}, base)
    with pytest.raises(Conflict):
        store.commit({"chunks": rows(spark, ("c", "late"))}, {}, base)
    assert held(store.snapshot()) == [("a", "1"), ("b", "mine")]


SHAPE = "project string, source string, external_id string, ordinal int, title string, url string, modified_at timestamp"


def listing(spark, *files):
    """files: (external_id, title, day)"""
    own = [(p, "drive", i, n, t, "u") for n, (p, i, t, _) in enumerate(files)]
    days = spark.createDataFrame([(n, d) for n, (*_, d) in enumerate(files)], "ordinal int, day int")
    frame = spark.createDataFrame(own, SHAPE.rpartition(",")[0]).join(days, "ordinal")
    return frame.select("project", "source", "external_id", "ordinal", "title", "url", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, day)").alias("modified_at"))


def test_refresh_counts(spark, store):
    count = lambda run, *files, **more: ingest.refresh(store, listing(spark, *files), run, NOW, **more)
    titles = lambda: {r.external_id: r.title for r in store.snapshot().table("meta").collect()}
    assert count("1", ("p", "d1", "spec", 1), ("p", "d2", "note", 1), ("p", "d2", "again", 1), ("p", "", "x", 1)) == {"added": 2, "updated": 0, "removed": 0, "unchanged": 0, "synced": 2}
    assert titles() == {"d1": "spec", "d2": "note"}
    assert count("2", ("p", "d1", "spec", 1), ("p", "d2", "note", 1)) == {"added": 0, "updated": 0, "removed": 0, "unchanged": 2, "synced": 2}
    assert count("3", ("p", "d1", "spec", 2), ("p", "d2", "renamed", 1))["updated"] == 2
    # what wasn't listed, another project, is not removed
    assert count("4", ("q", "d1", "other", 1)) == {"added": 1, "updated": 0, "removed": 0, "unchanged": 0, "synced": 1}
    assert count("5", ("p", "d1", "spec", 2)) == {"added": 0, "updated": 0, "removed": 1, "unchanged": 1, "synced": 1}
    assert store.snapshot().table("meta").where("project = 'p'").count() == 1 and titles()["d1"] in ("spec", "other")


def test_refresh_goes_on_where_it_stopped(spark, store):
    files = [("p", f"d{i}", f"t{i}", 1) for i in range(20)]
    ingest.refresh(store, listing(spark, *files[:10]), "first", NOW)
    with pytest.raises(RuntimeError):
        ingest.refresh(store, listing(spark, *files[5:]), "second", NOW, batch_rows=4, fail_at=2)
    part = store.snapshot()
    assert {"second/0", "second/1"} <= part.log.keys() and "second/2" not in part.log
    total = ingest.refresh(store, listing(spark, *files[5:]), "second", NOW, batch_rows=4)
    assert total == {"added": 10, "updated": 0, "removed": 5, "unchanged": 5, "synced": 15}
    assert ingest.refresh(store, listing(spark, *files[5:]), "second", NOW, batch_rows=4) == total  # done: nothing is counted twice
    assert {r.external_id for r in store.snapshot().table("meta").collect()} == {f[1] for f in files[5:]}


def test_refresh_with_bodies(spark, store):
    files = [("p", "good", "Good", 1), ("p", "empty", "Empty", 1), ("p", "lost", "Lost", 1)]
    ids = {r.external_id: r.document_id for r in listing(spark, *files).withColumn("document_id", ingest._meta_id()).collect()}
    bodies = lambda **own: spark.createDataFrame([(ids[k], t, s) for k, (t, s) in own.items()], "document_id string, text string, status string")
    one = ingest.refresh(store, listing(spark, *files), "1", NOW, bodies(good=("# A\nx\n# B\ny", "ok"), empty=(" \n", "ok"), lost=(None, "timeout")))
    assert (one["added"], one["fetched_bodies"]) == (3, 2)
    indexed = lambda: {r.external_id: r.indexed_id is not None for r in store.snapshot().table("meta").collect()}
    assert indexed() == {"good": True, "empty": False, "lost": False}
    assert sorted(r.text for r in store.snapshot().table("chunks").collect()) == ["# A\nx", "# B\ny"]
    # those not indexed are asked for again, though nothing changed
    two = ingest.refresh(store, listing(spark, *files), "2", NOW, bodies(good=("never read", "ok"), empty=(" ", "ok"), lost=("now here", "ok")))
    assert (two["unchanged"], two["fetched_bodies"]) == (3, 2) and indexed()["lost"]
    assert sorted(r.text for r in store.snapshot().table("chunks").collect()) == ["# A\nx", "# B\ny", "# 개요\nnow here"]
    # changed to empty: the old text goes; removed: its document goes
    ingest.refresh(store, listing(spark, ("p", "good", "Good", 2), ("p", "empty", "Empty", 1)), "3", NOW, bodies(good=("", "ok")))
    assert indexed() == {"good": False, "empty": False} and store.snapshot().table("documents").count() == store.snapshot().table("chunks").count() == 0


API = json.dumps({"openapi": "3.0.0", "info": {"title": "Shop", "version": "2"}, "paths": {"/carts": {"get": {"operationId": "list", "responses": {"200": {"description": "ok"}}}}}, "components": {"schemas": {"Cart": {"type": "object"}}}})


def test_ingest(spark, store):
    shape = "document_id string, project string, source_url string, text string, doc_type string"
    raw = [("a", "p", "http://a", API, None), ("b", "p", "http://b.md", "# One\nx\n# Two\ny", None), ("c", "p", None, "n,m\n1,2\n", "csv"), ("d", " ", None, "text", None), ("e", "p", "http://a", "again", "markdown"), ("f", "p", None, "<x/>", "xml"), ("g", "p", None, "openapi: 3.0.1", None), ("h", "p", None, None, None)]
    docs = spark.createDataFrame(raw, shape)
    assert ingest.ingest(store, docs, "1", NOW, batch_rows=5) == {"registered": 3, "failed": 5, "total": 8}
    now = store.snapshot()
    assert {r.document_id: r.code for r in now.table("history").where("status = 'failed'").collect()} == {"d": "validation_error", "e": "duplicate_document", "f": "parser_error", "g": "parser_error", "h": "parser_error"}
    assert {(r.document_id, r.title, r.version, r.doc_type) for r in now.table("documents").collect()} == {("a", "Shop", "2", "openapi"), ("b", "One", "", "markdown"), ("c", "Untitled Document", "", "csv")}
    assert sorted((r.document_id, r.chunk_type) for r in now.table("chunks").collect()) == [("a", "endpoint"), ("a", "schema"), ("b", "section"), ("b", "section"), ("c", "section")]
    changed = spark.createDataFrame([*raw[:1], ("b", "p", "http://b.md", "# Three\nz", None)], shape)
    assert ingest.ingest(store, changed, "2", NOW) == {"skipped": 1, "reindexed": 1, "total": 2}
    assert [r.text for r in store.snapshot().table("chunks").where("document_id = 'b'").collect()] == ["# Three\nz"]
    assert ingest.ingest(store, changed, "3", NOW, force=True) == {"reindexed": 2, "total": 2}
    assert ingest.delete(store, spark.createDataFrame([("a",), ("zz",)], "document_id string"), "4") == {"removed": 1, "missing": 1}
    assert {r.document_id for r in store.snapshot().table("chunks").collect()} == {"b", "c"} and store.snapshot().table("endpoints").count() == 0


def test_reembedding_by_change(spark, store):
    shape = "document_id string, chunk_id string, text string"
    store.commit({"chunks": spark.createDataFrame([(d, f"{d}{n}", f"word{n} {d}") for d in "abcd" for n in range(3)], shape)}, {})
    embed = lambda todo: todo.where("chunk_id <> 'b1'").select("chunk_id", F.array(F.length("text").cast("double")).alias("embedding"))
    vectors = lambda: {(r.chunk_id, r.model) for r in store.snapshot().table("embeddings").collect()}
    assert ingest.reembed(store, "1", "m", embed, batch_rows=5) == {"embedded": 12, "kept": 0}
    assert ingest.reembed(store, "2", "m", embed) == {"embedded": 0, "kept": 12}
    store.commit({"chunks": spark.createDataFrame([("a", "a0", "changed"), ("a", "a1", "word1 a")], shape)}, {"chunks": spark.createDataFrame([("a",), ("d",)], "document_id string")})
    assert ingest.reembed(store, "3", "m", embed) == {"embedded": 1, "kept": 7}
    assert vectors() == {(x, "m") for x in ("a0", "a1", "b0", "b1", "b2", "c0", "c1", "c2")}
    assert ingest.reembed(store, "4", "m2", embed) == {"embedded": 8, "kept": 0} and {m for _, m in vectors()} == {"m2"}
