"""Ranked lexical search against scores of all documents."""

import math
import random
import re

import pytest

from spindrift.llm import lexical_search


def plain(docs, items, k):
    """Every document's score for every item."""
    split = lambda t: [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").encode().lower())]
    words = [(i, split(t)) for i, t in docs]
    n_docs, n_words = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = {}
    for _, w in words:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, w in words:
            score = 0
            for t in split(text):
                if tf := w.count(t):
                    m = 100 - 75 + 75 * len(w) * n_docs // n_words
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
            if score:
                scores.append((-score, -1 if i is None else i, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def corpus():
    dice = random.Random(2)
    common, rare = ["the", "of", "Ünï", "數據"], [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(dice.choice(common if dice.random() < 0.5 else rare) for _ in range(dice.randint(0, 60)))) for i in range(400)]
    docs += [(1000 + i, "the very same text w1 w2, W2") for i in range(30)] + [(2000, None), (2001, ""), (2002, " .,_- "), (None, "w5 w6 of"), (7, "w7 W7"), (7, "w7 w8"), (2003, "w9 " * 30_000)]
    items = [(i, " ".join(dice.choice(common + rare) for _ in range(dice.randint(1, 25)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "the very same text"), (103, "w1"), (104, "of of of w3"), (104, "of of of w3"), (None, "w4"), (105, "w9")]
    return docs, items


@pytest.mark.parametrize("k, blocks, broadcast", [(10, 1_000_000, 1 << 24), (3, 500, 0)])
def test_same_as_all_scores(spark, corpus, k, blocks, broadcast, monkeypatch):
    docs, items = corpus
    monkeypatch.setattr(lexical_search, "BROADCAST_BYTES", broadcast)
    monkeypatch.setattr(lexical_search, "SHARD_ITEMS", 7 if not broadcast else 1000)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, term string, block long").repartition(6)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, q int")
    got = lexical_search.search(lexical_search.build(table), asked, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(docs, list(dict.fromkeys(items)), k)


def test_terms_are_pruned(spark, corpus):
    docs, _ = corpus
    index = lexical_search.build(spark.createDataFrame(docs, "doc_id long, text string"))
    rows = {r.term: r for r in lexical_search.plan(index, spark.createDataFrame([(1, "the of w1 w1 w1")], "q long, text string"), 10).collect()}
    assert rows["w1"].leads and not (rows["the"].leads and rows["of"].leads)
    assert all(r.rest < r.threshold for r in rows.values())
    with pytest.raises(ValueError):
        lexical_search.plan(index, spark.createDataFrame([(1, "x")], "q long, text string"), 11)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build(none), some).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "...")], "doc_id long, text string")
    assert lexical_search.search(lexical_search.build(blank), some).count() == 0
    full = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical_search.search(lexical_search.build(full), some.where("false")).count() == 0
