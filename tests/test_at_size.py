"""What showed only on larger tables."""

import math
import random
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spindrift import storage
from spindrift.functions import vectors as V
from spindrift.operators import ranking
from spindrift.operators.indexes import build_keyword_index
from spindrift.plans import catalogue, ingest
from spindrift.sources import office, remote, sections
from spindrift.sources.store import Store


def test_hash_embed_rounds_as_sql_and_leaves_out_texts_without_terms(spark, tmp_path):
    # 41 of 640: 0.0640625 times a million lies below the half as a double, which SQL rounds down
    docs = spark.createDataFrame([(1, "a"), (2, ""), (3, "—"), (4, None)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.key for r in catalogue.QUERIES["hash_embed"](spark, str(tmp_path)).collect()] == [1]
    whole, catalogue.chunks.hash_embedding = catalogue.chunks.hash_embedding, lambda rows, key: rows.select(F.lit(1).alias("key"), F.lit(0).alias("bucket"), (F.lit(41.0) / 640).alias("value"))
    try:
        assert catalogue.QUERIES["hash_embed"](spark, str(tmp_path)).first().value == 0.064062
    finally:
        catalogue.chunks.hash_embedding = whole


def test_every_id_divisible_by_100_is_a_query_of_its_own(spark, tmp_path):
    rows = [(n, [1.0, n / 700]) for n in range(700)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalogue.QUERIES["vector_variants_min_rank"](spark, str(tmp_path))
    assert sorted({r.query_id for r in found.collect()}) == [0, 100, 200, 300, 400, 500, 600]


@pytest.mark.parametrize("block_rows", [7, 1 << 15])
def test_vector_topk_in_blocks(spark, block_rows):
    rng = random.Random(5)
    own = {n: [rng.uniform(-1, 1) for _ in range(3)] for n in range(40)}
    own |= {n: [0.5, 0.25, 1.0] for n in range(40, 60)}  # copies: equal scores go by key
    rows = spark.createDataFrame([*own.items(), (60, None), (61, [1.0, None, 0.0]), (62, [1.0, 1.0])], "key int, embedding array<double>")
    asked = rows.where("key % 6 = 0").withColumnRenamed("key", "query_id")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    want = set()
    for q in range(0, 60, 6):
        best = sorted((-round(s, 9), k) for k, v in own.items() if (s := cosine(own[q], v)) > 1e-9)
        want |= {(q, k, n) for n, (_, k) in enumerate(best[:5], 1)}
    found = ranking.vector_topk(rows, asked, 5, block_rows)
    assert {(r.query_id, r.key, r["rank"]) for r in found.collect()} == want
    # no row a pair: the meeting of two blocks gives its best
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_length_is_computed_once_a_vector(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "a array<double>").select(V.unit(F.col("a")).alias("u"))
    assert [r.u for r in rows.collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("SQRT") == 1


@pytest.mark.parametrize("seeds", [3, 12])
def test_pruned_keyword_arm_is_the_whole_one(spark, monkeypatch, seeds):
    rng = random.Random(7)
    monkeypatch.setattr(ranking, "SEEDS", seeds)
    monkeypatch.setattr(ranking, "IMPACTS", 4)
    words = [f"w{n}" for n in range(40)]
    text = lambda n: " ".join(rng.choices(words, [1 / (x + 1) for x in range(40)], k=n))
    docs = spark.createDataFrame([(n, f"p{n % 3}", text(rng.choice([0, 2, 5, 20, 80]))) for n in range(150)], "doc_id int, project string, text string")
    queries = spark.createDataFrame([(n, text(n % 9), [text(3)]) for n in range(25)] + [(90, "none such", ["w0"])], "query_id int, text string, variants array<string>")
    index = build_keyword_index(docs, "doc_id", scope=("project",))
    for own in (index, index.scoped(F.col("project") != "p1")):
        for asked in (queries, queries.drop("variants")):
            rows = lambda found: sorted((r.query_id, r.key, r["rank"], round(r.score, 6)) for r in found.collect())
            assert rows(own.topk(asked, 4)) == rows(ranking.keyword_topk(own.rows, asked, 4, own.slices))
    # a document is looked at for some of the terms only
    hits = ranking.pruned_hits(index.rows, queries, 4, index.slices, index.terms, index.docs).count()
    assert seeds < 4 or hits < ranking.keyword_hits(index.rows, queries, index.slices).count() / 2


def test_keys_of_several_scopes_are_not_pruned(spark):
    docs = spark.createDataFrame([(1, "p", "a b"), (1, "q", "a a"), (2, "p", "a")], "doc_id int, project string, text string")
    index = build_keyword_index(docs, "doc_id", scope=("project",))
    assert index.docs is None
    asked = spark.createDataFrame([(1, "a b")], "query_id int, text string")
    assert [(r.key, r["rank"]) for r in index.topk(asked, 1).collect()] == [(1, 1)]


def test_blocks_are_read_once_for_all_levels(spark):
    # their texts were worked out anew for each level and all levels above it, ten times for four
    blocks = spark.createDataFrame([(f"b{n}", "p" if n == 0 else f"b{n - 1}", n, "paragraph", f'{{"paragraph":{{"rich_text":[{{"plain_text":"x{n}"}}]}}}}') for n in range(6)], "block_id string, parent_id string, ordinal int, type string, block string")
    found = remote.page_bodies(spark.createDataFrame([("p",)], "page_id string"), blocks)
    assert [tuple(r) for r in found.collect()] == [("p", "x0\nx1\nx2\nx3")]
    assert "get_json_object" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_office_files_are_read_a_few_at_a_time():
    # all contents of an Arrow batch, 10,000 rows, were Python objects at once
    batch = pa.RecordBatch.from_arrays([pa.array([f"{n}.docx" for n in range(1000)])], names=["path"])
    parts = list(office._few(iter([batch])))
    assert max(p.num_rows for p in parts) <= 64 and [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_batches_read_their_own_rows(spark, tmp_path, monkeypatch):
    # each batch looked for its rows in those of all
    calls = []
    deal = ingest._dealt

    def dealt(rows, label):
        part = deal(rows, label)

        def own(batches, n):
            found = part(batches, n)
            calls.append((label, {f.split("/")[-2] for f in found.inputFiles()}, found.count()))
            return found

        return own

    monkeypatch.setattr(ingest, "_dealt", dealt)
    raw = spark.createDataFrame([(str(n), "p", None, f"# T{n}\ntext {n}", "markdown") for n in range(90)], "document_id string, project string, source_url string, text string, doc_type string")
    store = Store(spark, str(tmp_path))
    assert ingest.ingest(store, raw, "first", datetime(2024, 1, 1), batch_rows=30) == {"registered": 90, "total": 90}
    embed = lambda todo: todo.select("chunk_id", F.array(F.lit(1.0)).alias("embedding"))
    assert ingest.reembed(store, "e", "m", embed, batch_rows=30) == {"embedded": 90, "kept": 0}
    assert ingest.reembed(store, "again", "m", embed, batch_rows=30) == {"embedded": 0, "kept": 90}
    for label in ("raw", "chunks"):
        own = [c for c in calls if c[0] == label]
        assert len(own) == 3 * (1 + (label == "chunks")) and all(len(c[1]) == 1 and c[1] == {f"_part={n % 3}"} for n, c in enumerate(own)) and sum(c[2] for c in own[:3]) == 90


def test_sections_are_cut_within_a_document(spark):
    # lines were shuffled and sorted to find the heading above them, once for the sections and once for their chunks
    text = "pre\n# A \r\nx\n\n y\n## B\n\n#\tC\x85z \n#D\n"
    found = sections.markdown_sections(spark.createDataFrame([("a", text), ("b", None), ("c", "# only"), ("d", "\n "), ("a", "one")], "document_id string, text string"))
    own = lambda *rows: [("a", n, *r) for n, r in enumerate(rows)]
    assert [tuple(r) for r in found.collect()] == own((sections.PREAMBLE, "pre"), ("A", "x\n\n y"), ("C", "z\n\n#D")) + own((sections.PREAMBLE, "one"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_batches_look_through_their_own_stored_hashes(spark, tmp_path, monkeypatch):
    # each batch read the hashes of all documents that are stored
    seen = []
    judge = ingest.outcome
    monkeypatch.setattr(ingest, "outcome", lambda raw, known, *rest: seen.append(known.count()) or judge(raw, known, *rest))
    raw = spark.createDataFrame([(str(n), "p", None, f"# T{n}\ntext {n}", "markdown") for n in range(60)], "document_id string, project string, source_url string, text string, doc_type string")
    store = Store(spark, str(tmp_path))
    ingest.ingest(store, raw, "first", datetime(2024, 1, 1), batch_rows=30)
    assert ingest.ingest(store, raw, "second", datetime(2024, 1, 1), batch_rows=30) == {"skipped": 60, "total": 60}
    assert seen[:2] == [0, 0] and sum(seen[2:]) == 60 and len(seen) == 4


@pytest.mark.parametrize("scope", [(), ("project",)])
def test_queries_that_ask_the_same_are_answered_once(spark, monkeypatch, scope):
    # the verb and path of every page was met with all titles that hold `en`, so the work grew with the square of the pages
    docs = spark.createDataFrame([(n, f"p{m}", f"en {'de ' * (n % 5)}w{n}") for n in range(40) for m in range(2)], "doc_id int, project string, text string")
    texts = [f"get en x{n}" for n in range(60)] + ["get de en", "en", "en get", "w1 EN y", "none", "", None, "en de post", "de de en delete"]
    queries = spark.createDataFrame([(n, t, ["w2"] if n % 7 == 0 else []) for n, t in enumerate(texts)], "query_id int, text string, variants array<string>")
    monkeypatch.setattr(ranking, "ALIKE", 7)
    index = build_keyword_index(docs, "doc_id", scope=scope)
    assert (index.docs is None) == bool(scope)
    rows = lambda found: sorted((r.query_id, r.key, r["rank"], r.score) for r in found.collect())
    asked = []
    for name in ("pruned_hits", "keyword_hits"):
        monkeypatch.setattr(ranking, name, lambda rows, queries, *rest, f=getattr(ranking, name): asked.append(queries.count()) or f(rows, queries, *rest))
    found = rows(index.topk(queries, 5))
    assert asked == [6]
    assert found == rows(ranking.keyword_topk(index.rows, queries, 5, index.slices))


def test_building_an_index_leaves_no_shuffles(spark, tmp_path):
    # they stayed until the driver collected its garbage, those by document beside those by term
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    shuffles = lambda: {f for f in (files().apply(n).getName() for n in range(files().size())) if f.startswith("shuffle_")}
    docs = spark.createDataFrame([(n % 90, f"a{n % 7} b b") for n in range(100)], "doc_id int, text string")
    before = shuffles()
    index = build_keyword_index(docs, "doc_id", path=str(tmp_path / "index"))
    assert not {f for f in shuffles() - before if f.endswith(".data")}
    assert index.rows.where("key = 1 and term = 'b'").first().tf == 4
    folder = storage.shared_folder(spark)
    assert not [n for n in storage.names(spark, folder) if n.startswith("postings-")]
