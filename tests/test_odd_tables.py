"""Catalogue queries over tables with odd rows give what their SQL gives."""

import duckdb
from pyspark.sql import functions as F

from spindrift.operators import sync
from spindrift.plans.catalogue import ORACLES, QUERIES

#: Texts that are null, empty or blank in one way or another, beside others; each under ids of every remainder that the queries tell apart.
TEXTS = [None, "", " ", "   ", "\n", " \t\r\n", "  ", " ", "one", "# More\nelse", "x\r", "a\n\nb ", "#"]


def same_as_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for table, rows in tables.items():
        path = f"{folder}/{table}.parquet"
        rows.coalesce(1).write.parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    rows = QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, want))


def odd_documents(spark):
    rows = [(n, text, f"src{n % 3}", "en") for n, text in enumerate(TEXTS * 30)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


def test_body_actions_of_blank_texts(spark, tmp_path):
    # a blank text was cleared, which the SQL says of every seventh only
    same_as_sql(spark, tmp_path, "body_actions", documents=odd_documents(spark))


def test_body_actions_give_each_body_one_row(spark):
    # an id that is stored twice made two rows, and white space other than U+0020 was no empty body
    bodies = spark.createDataFrame([("a", "x", "ok"), ("a", "y", "ok"), ("b", "\n ", "ok"), ("c", None, "ok"), ("d", "x", "timeout"), (None, "x", "ok")], "document_id string, text string, status string")
    known = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", "z"), ("b", "x")], "document_id string, text string").select("document_id", F.sha2("text", 256).alias("content_hash"))
    found = sorted((str(r.document_id), r.action) for r in sync.body_actions(bodies, known).collect())
    assert found == [("None", "index"), ("a", "index"), ("a", "skip"), ("b", "clear"), ("c", "clear"), ("d", "failed")]
    assert "skip" not in {r.action for r in sync.body_actions(bodies, known, force=True).collect()}


def test_ingest_documents_of_blank_texts(spark, tmp_path):
    # a blank text failed, which the SQL says of every seventeenth only
    same_as_sql(spark, tmp_path, "ingest_documents", documents=odd_documents(spark))
