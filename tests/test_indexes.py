"""Stored indexes: the same results as without them, no shuffle of the postings, and opened again by path."""

import random

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spindrift import storage
from spindrift.operators import indexes, ranking, vector_index
from spindrift.plans import search

WORDS = ["alpha", "beta", "gamma", "결제", "주문", "x1", "the", "api_v2"]


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(3)
    rows = [(i, " ".join(draw.choices(WORDS, k=draw.randint(0, 12))), draw.choice(["p", "q"]), draw.choice(["drive", "markdown"])) for i in range(200)]
    return spark.createDataFrame([*rows, (900, None, "p", "drive")], "key long, text string, project string, doc_type string")


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(1, "alpha 결제", ["beta"]), (2, "", ["alpha"]), (3, "the", []), (4, "nowhere", ["gamma x1"]), (5, None, None)], "query_id int, text string, variants array<string>")


@pytest.mark.parametrize("slice_docs", [10**6, 30])
def test_keyword_index(spark, docs, queries, slice_docs, monkeypatch):
    monkeypatch.setattr(indexes, "SLICE_DOCS", slice_docs)
    path = storage.fresh(spark, "index")
    built = indexes.build_keyword_index(docs, "key", scope=("project", "doc_type"), path=path)
    index = indexes.open_keyword_index(spark, path)
    assert index.slices == built.slices == (1 if slice_docs > 200 else 7)
    want = sorted(ranking.keyword_topk(ranking.postings(docs, "key"), queries, 20).collect())
    assert want and sorted(built.topk(queries, 20).collect()) == sorted(index.topk(queries, 20).collect()) == want
    own = docs.where("project = 'p' and doc_type = 'drive'")
    scoped = index.scoped(search.Scope(project="p", doc_types=("drive",)).where(*index.rows.columns))
    assert sorted(scoped.topk(queries, 20).collect()) == sorted(ranking.keyword_topk(ranking.postings(own, "key"), queries, 20).collect())


def test_postings_are_not_shuffled(spark, docs, queries):
    index = indexes.build_keyword_index(docs, "key", scope=("project",))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = ranking.keyword_hits(index.rows.where("project = 'p'"), queries, index.slices)
        plan = hits._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    join = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x or "ShuffledHashJoin" in x)
    scan = next(i for i, x in enumerate(lines) if "FileScan parquet" in x and "Bucketed: true" in x)
    assert scan > join and not any("Exchange" in x for x in lines[join:scan] if depth(x) < depth(lines[scan])), plan
    assert "PushedFilters" in lines[scan] and "EqualTo(project,p)" in plan


def title_rank(pages, queries, k):
    """Every page against every query."""
    import re

    terms = lambda t: list(dict.fromkeys(x.lower() for x in re.findall("[0-9A-Za-z_]+|[가-힣]+", t or "")))
    tight = lambda t: "".join((t or "").split()).lower()
    out = []
    for q, text, variants in queries:
        own = terms(text)
        if not own:
            continue
        near, close = terms(" ".join([text, *(variants or [])])), {tight(x) for x in [text, *(variants or [])]} - {""}
        found = []
        for key, title, url in pages:
            low = [(x or "").lower() for x in (title, url)]
            if any(t in x for t in near for x in low) or any(c in x.replace(" ", "") for c in close for x in low):
                have = set(terms(title)) | set(terms(url))
                score = max(sum(t in have for t in own), int(tight(text) in tight(title) + tight(url))) / len(own)
                found.append((score <= 0, -round(score, 9), key))
        out += [(q, key, n, round(-s, 6)) for n, (_, s, key) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_title_index(spark):
    draw = random.Random(4)
    parts = ["Pay", "결제", "order list", "API", "v2", "a", "%", "_", "트러블 슈팅", "x y", "İ"]
    pages = [(i, "".join(draw.choice(parts) + draw.choice(["", " ", "-"]) for _ in range(draw.randint(0, 5))), draw.choice([None, "", f"http://h/{draw.choice(parts)}/{i}"])) for i in range(150)] + [(500, None, None)]
    queries = [(1, "order", None), (2, "트러블슈팅", []), (3, "a", None), (4, "nothing", ["pay", "x  y"]), (5, "", ["pay"]), (6, "orderlist api", None), (7, "%_", ["v2"]), (8, "_", None), (9, "결", None)]
    index = indexes.build_title_index(spark.createDataFrame(pages, "key int, title string, url string"))
    asked = spark.createDataFrame(queries, "query_id int, text string, variants array<string>")
    rows = index.topk(asked, 20)
    assert sorted((r.query_id, r.key, r.rank, round(r.score, 6)) for r in rows.collect()) == title_rank(pages, queries, 20)
    assert "CartesianProduct" not in (plan := rows._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


def test_vector_index(spark):
    dice = np.random.default_rng(1)
    centres = dice.normal(size=(12, 16))
    own = [(i, (centres[i % 12 if i % 3 else 0] + 0.3 * dice.normal(size=16)).tolist(), "p" if i % 2 else "q") for i in range(600)]
    vectors = spark.createDataFrame([*own, *[(1000 + i, own[0][1], "p") for i in range(60)], (2000, None, "p"), (2001, [0.0] * 16, "p")], "key long, embedding array<double>, project string")
    path = storage.fresh(spark, "cells")
    built = vector_index.build_vector_index(vectors, scope=("project",), path=path)
    index = vector_index.open_vector_index(spark, path)
    asked = vectors.where("key % 100 = 0").select(F.col("key").alias("query_id"), "embedding")
    exact = ranking.vector_topk(vectors, asked, 10)
    got = vector_index.recall(exact, index.topk(asked, 10)).first()
    assert got.recall >= 0.9 and index.probes < len(index.centres) and built.probes == index.probes
    every = index.topk(asked, 10, probes=len(index.centres))
    same = lambda rows: sorted((r.query_id, r.key, r["rank"], round(r.score, 9)) for r in rows.collect())
    assert same(every) == same(exact)
    scoped = index.topk(asked, 10, F.col("project") == "q", len(index.centres))
    assert same(scoped) == same(ranking.vector_topk(vectors.where("project = 'q'"), asked, 10))
    assert vector_index.build_vector_index(vectors.where("false")).topk(asked, 10).count() == 0


def test_indexed_search_shows_what_callers_need(spark):
    pages = spark.createDataFrame([(1, "Pay guide v1.2", "u1", "drive"), (2, "Orders", "u2", "notion"), (3, "Pay old", "u3", "drive")], "key int, title string, url string, source string")
    chunks = spark.createDataFrame([(10, 1, "how to pay", "drive"), (11, 1, "refund", "drive"), (20, 2, "pay for an order here", "notion"), (30, 3, "pay", "drive"), (40, 4, "pay without a row", "drive")], "chunk int, key int, text string, doc_type string")
    titles, sections = indexes.build_title_index(pages.select("key", "title", "url")), indexes.build_keyword_index(chunks, "chunk", scope=("doc_type",))
    meta = pages.where("key <> 3").withColumn("project", F.lit("p")).withColumn("last_synced_at", F.lit("2024-05-01").cast("timestamp"))
    queries, rejected = search.searchable(spark.createDataFrame([(1, "pay"), (2, " "), (3, "%%")], "query_id int, text string"))
    assert sorted((r.query_id, r.code) for r in rejected.collect()) == [(2, "validation_error"), (3, "validation_error")]
    seen = Observation()
    rows = search.search_indexed(queries, titles, meta, sections, chunks.select("chunk", "key", "text"), top_k=2, seen=seen).collect()
    rows.sort(key=lambda r: r["rank"])
    assert [(r.key, r.title, r.source, r.version, r.winner, r.snippet) for r in rows] == [(1, "Pay guide v1.2", "drive", "v1.2", 10, "how to pay"), (2, "Orders", "notion", None, 20, "pay for an order here")]
    assert seen.get["dangling"] == 2 and rows[0].snippet_as_of is not None
    only = search.search_indexed(queries, titles, meta, sections, chunks.select("chunk", "key", "text"), top_k=2, source="notion").collect()
    assert [(r.key, r["rank"]) for r in only] == [(2, 1)]
    vectors = spark.createDataFrame([(11, [1.0, 0.0], "drive"), (20, [0.0, 1.0], "notion")], "key int, embedding array<double>, doc_type string")
    asked = spark.createDataFrame([(1, [1.0, 0.1])], "query_id int, embedding array<double>")
    both = search.search_indexed(queries, titles, meta, sections, chunks.select("chunk", "key", "text"), vectors, asked, top_k=2).orderBy("rank").collect()
    assert [(r.key, r.winner) for r in both] == [(1, 10), (2, 20)]  # the keyword arm's chunk before the vector arm's


def test_winner_of_the_vector_arm(spark):
    rows = lambda w: spark.createDataFrame([(1, "a", 1, w)], "query_id int, key string, rank int, winner int")
    assert [r.winner for r in ranking.winners({"vector": rows(7)}).collect()] == [7]
    assert [r.winner for r in ranking.winners({"vector": rows(7), "keyword": rows(8)}).collect()] == [8]
