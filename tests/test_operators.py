import random
import re

import pytest
from pyspark.sql import functions as F

from spindrift.errors import ValidationError, checked_project, checked_source, checked_top_k
from spindrift.operators import chunks, ranking, snippets, sync
from spindrift.streaming import refresh


BOUNDARY = re.compile(r"(?<=[.!?。])\s+|\n")


def packed(parts, glue, budget, finer):
    """A plain packer of words."""
    out, held = [], None
    for part in parts:
        if len(part.split()) > budget:
            out += ([] if held is None else [held]) + finer(part)
            held = None
        elif held is not None and len((held + glue + part).split()) <= budget:
            held += glue + part
        else:
            out += [] if held is None else [held]
            held = part
    return out if held is None else [*out, held]


def plain_parts(title, content, limit):
    head = f"# {title}\n" if title else ""
    if len((head + content).split()) <= limit:
        return [head + content]
    budget = max(1, limit - len(head.split()))

    def cut(text):
        words = re.findall(r"\s*\S+\s*", text)
        return ["".join(words[i : i + budget]) for i in range(0, len(words), budget)]

    sentences = lambda p: packed([x for x in BOUNDARY.split(p) if x], " ", budget, cut)
    return [head + x for x in packed(content.split("\n\n"), "\n\n", budget, sentences)]


def test_split_sections(spark):
    draw = random.Random(5)
    made = ["".join(draw.choice(["w ", "word. ", "\n", "\n\n", "longer ", "\t", "끝。 ", " ", "x"]) for _ in range(draw.randint(0, 120))) for _ in range(150)]
    fixed = ["a b c\n\nd e f\n\ng h i", "One two. Three four! Five", "short", "", "\n\n\n\n", " " + "long " * 5000, "x" * 3000]
    rows = [(i, draw.choice(["t", "", None, "two words"]), t) for i, t in enumerate(fixed + made)]
    for limit in (1, 5, 8):
        got = {}
        for r in chunks.split_sections(spark.createDataFrame(rows, "id int, title string, content string"), limit).orderBy("id", "part").collect():
            got.setdefault(r.id, []).append(r.text)
        assert got == {i: plain_parts(title, content, limit) for i, title, content in rows}
    assert chunks.split_sections(spark.createDataFrame([(1, None, None)], "id int, title string, content string")).collect()[0].text == ""


def plain_snippet(text, wanted):
    def places(part):
        dense, at = "".join(part.split()).lower(), [i for i, c in enumerate(part) if not c.isspace()]
        found = [part.lower().find(w) if w in part.lower() else at[dense.find(w)] if w in dense else None for w in wanted]
        return [f for f in found if f is not None]

    starts = sorted({max(0, p - 60) for p in places(text)})
    best = max(starts, key=lambda s: len(places(text[s : s + 300])), default=0)
    return " ".join(text[best : best + 300].split())


def test_snippets(spark):
    draw = random.Random(9)
    body = "api " + "x " * 100 + "order list api " + "y " * 100
    rows = [("api orderlist", body), ("zzz", "no  match\nhere"), ("end", "e\tn d" * 9), ("q", None), ("q", "")]
    rows += [(" ".join(draw.choices(["api", "orderlist", "cat", "é", "결제", "list2"], k=draw.randint(1, 4))), "".join(draw.choice(["api ", "order", " list", "cat\n", "é", "결 제", "filler words here ", "\t\t"]) for _ in range(draw.randint(1, 200)))) for _ in range(120)]
    got = snippets.with_snippets(spark.createDataFrame([(i, q, "T", t) for i, (q, t) in enumerate(rows)], "id int, query string, title string, text string")).collect()
    for r in got:
        wanted = list(dict.fromkeys(w.lower() for w in re.findall("[0-9A-Za-z_]+|[가-힣]+", r.query)))
        assert r.snippet == (plain_snippet(r.text, wanted) if r.text else f"No passage for '{r.query}' found in the text. Only the title matches: T")


def test_fusion_against_the_formula(spark):
    draw = random.Random(7)
    lists = {(q, a): [draw.randrange(12) for _ in range(8)] for q in range(6) for a in ("keyword", "vector", "title")}
    frames = {}
    for arm in ("keyword", "vector", "title"):
        rows = [(q, str(k), n + 1) for (q, a), keys in lists.items() if a == arm for n, k in enumerate(keys)]
        frames[arm] = spark.createDataFrame(rows, "query_id int, key string, rank int")
    got = {}
    for r in ranking.fuse(frames, 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.key, r.score))
    for q in range(6):
        score = {}
        for arm in ("keyword", "vector", "title"):
            for place, key in enumerate(dict.fromkeys(map(str, lists[q, arm])), 1):
                score[key] = score.get(key, 0.0) + 1 / (60 + place)
        best = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert sorted(got[q]) == [(n, k, s) for n, (k, s) in enumerate(best, 1)]


def test_checks():
    assert checked_top_k(50) == 50
    assert checked_project(" p ") == "p"
    assert checked_source("drive") == "drive"
    for bad in (lambda: checked_top_k(0), lambda: checked_project(" "), lambda: checked_source("x")):
        with pytest.raises(ValidationError):
            bad()


def test_diff_stays_within_what_was_listed(spark):
    shape = "project string, source string, external_id string, title string, url string, modified_at string"
    stored = spark.createDataFrame([("a", "drive", "1", "t", "u", "m"), ("b", "drive", "1", "t", "u", "m")], shape)
    listing = spark.createDataFrame([("a", "drive", "2", "t", "u", None)], shape)
    assert {(r.project, r.external_id, r.change) for r in sync.diff(stored, listing).collect()} == {("a", "1", "removed"), ("a", "2", "added")}


def test_streamed_refresh(spark, tmp_path):
    shape = "project string, source string, external_id string, ordinal int, title string, url string, modified_at string"
    for n, rows in enumerate([[("p", "drive", "1", 0, "a", "u", "m"), ("p", "drive", "1", 1, "twice", "u", "m"), ("p", "drive", "2", 2, "b", "u", "m")], [("p", "drive", "2", 0, "renamed", "u", "m")]]):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).json(str(tmp_path / "in"))
        refresh.refreshing(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        kept = {r.external_id: r.title for r in spark.read.parquet(str(tmp_path / f"out/snapshot-{n}")).collect()}
        assert kept == ({"1": "a", "2": "b"}, {"2": "renamed"})[n]


def test_event_counts_keep_a_watermark(spark):
    rows = spark.readStream.format("rate").load().select(F.col("timestamp").alias("ts"), F.lit("x").alias("event_type"))
    assert refresh.event_counts(rows).isStreaming


def test_snippets_of_one_text_are_dealt_to_several_tasks(spark):
    # one text that all queries find; its rows came from the one task that read it
    text = "pay for an order here\x1c\u00a0or\u2003t h ere é~ " * 50
    rows = spark.createDataFrame([(i, f"order {i}", "T", text) for i in range(60)], "id int, query string, title string, text string").coalesce(1)
    got = snippets.with_snippets(rows).select("id", "query", "snippet", F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in got}) > 1 and {r.id for r in got} == set(range(60))
    assert all(r.snippet == plain_snippet(text, ["order", str(r.id)]) for r in got)
