"""The reader of responses linked by cursors: batch, filters, and a stream that goes on where it stopped."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from spindrift import storage
from spindrift.sources import paged, remote


def items(spark, collection, numbers):
    rows = [(collection, n, json.dumps({"id": f"{collection}{n}", "last_edited_time": f"2024-01-{n % 28 + 1:02d}T00:00:00Z", "title": 'a "quoted" 결제'})) for n in numbers]
    return spark.createDataFrame(rows, "collection string, ordinal int, item string")


@pytest.fixture()
def path(spark):
    paged.register(spark)
    return storage.fresh(spark, "responses")


def read(spark, path, **options):
    return spark.read.format("spindrift_pages").options(**options).load(path)


def test_follows_cursors(spark, path):
    paged.store_responses(items(spark, "a", range(25)).union(items(spark, "b", range(3))), path, size=4)
    rows = read(spark, path)
    assert rows.rdd.getNumPartitions() == 2
    got = sorted((r.collection, r.id) for r in rows.collect())
    assert got == sorted([("a", f"a{n}") for n in range(25)] + [("b", f"b{n}") for n in range(3)])
    assert rows.where("id = 'a9'").first().cursor == "c2" and json.loads(rows.where("id = 'a9'").first().item)["title"] == 'a "quoted" 결제'
    assert rows.where("id = 'a9'").first().modified_at == datetime(2024, 1, 10)


def test_filters_are_pushed(spark, path):
    paged.store_responses(items(spark, "a", range(25)).union(items(spark, "b", range(3))), path, size=4)
    one = read(spark, path).where("collection = 'b'")
    assert one.rdd.getNumPartitions() == 1 and one.count() == 3
    late = read(spark, path).where(F.col("modified_at") >= F.lit("2024-01-20").cast("timestamp"))
    assert late.count() == 6 and ">=" not in late._jdf.queryExecution().executedPlan().toString()
    assert read(spark, path).where("collection in ('a', 'z') and id = 'a3'").count() == 1


def test_broken_chains(spark, path):
    paged.store_responses(items(spark, "a", range(8)), path, size=4, end=False)
    with pytest.raises(Exception, match="no response for the cursor c2"):
        read(spark, path).collect()
    assert read(spark, path, open="true").count() == 8
    spark.createDataFrame([('{"results": [], "has_more": true, "next_cursor": "start"}', "a", "c2")], "value string, collection string, cursor string").write.mode("append").partitionBy("collection", "cursor").text(path)
    with pytest.raises(Exception, match="comes again"):
        read(spark, path).collect()


def test_stream_goes_on(spark, path):
    out, checkpoint = storage.fresh(spark, "out"), storage.fresh(spark, "checkpoint")

    def run():
        stream = spark.readStream.format("spindrift_pages").load(path)
        query = stream.select("collection", "id", "cursor").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).start()
        query.processAllAvailable()
        query.stop()
        return sorted(r.id for r in spark.read.parquet(out).collect())

    paged.store_responses(items(spark, "a", range(8)), path, size=4, end=False)
    assert run() == sorted(f"a{n}" for n in range(8))
    assert run() == sorted(f"a{n}" for n in range(8))
    paged.store_responses(items(spark, "a", range(100, 106)).withColumn("ordinal", F.col("ordinal") - 100), path, size=4, first=2)
    paged.store_responses(items(spark, "b", range(2)), path, size=4)
    assert run() == sorted([f"a{n}" for n in [*range(8), *range(100, 106)]] + ["b0", "b1"])


def test_page_tree(spark):
    child = lambda i, p, kind, title="": (i, p, kind, json.dumps({kind: {"title": title}}))
    blocks = [child("p1", "r", "child_page", "One"), child("t", "r", "toggle"), child("t2", "t", "column"), child("p2", "t2", "child_page", ""), child("d", "p1", "child_database"), child("p1", "row1", "child_page", "loop"), child("p3", "row1", "child_page", "deep"), child("x", "p3", "child_page", "deeper"), child("y", "x", "child_page", "too deep"), child("t", "t2", "toggle")]
    frame = spark.createDataFrame(blocks, "block_id string, parent_id string, type string, block string")
    rows = spark.createDataFrame([("d", "row1", "Row"), ("other", "row2", "No")], "database_id string, external_id string, title string")
    got = sorted(tuple(r) for r in remote.page_tree(spark.createDataFrame([("r",)], "root string"), frame, rows, depth=3).collect())
    assert got == [("r", "p1", "One", 1), ("r", "p2", remote.UNTITLED, 1), ("r", "p3", "deep", 3), ("r", "row1", "Row", 2), ("r", "x", "deeper", 4)]
