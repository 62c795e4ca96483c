"""Operators that SQL can't express, against libraries, plain Python, or all pairs."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from spindrift.llm import jaccard_join, line_dedup, linking, lm_score, token_orc
from spindrift.llm.common import fresh_path

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def test_token_ids_are_the_librarys(spark):
    dice = random.Random(3)
    pieces = ["the", "Zürich", "<|endoftext|>", "  ", "\n", "\t", "don't", "12345", "数据", "😀", ".", "a b", " x", "<|endoftext", "\r\n\r\n"]
    texts = ["".join(dice.choice(pieces) + dice.choice(["", " "]) for _ in range(dice.randint(0, 60))) for _ in range(300)] + ["<|endoftext|>", "a <|endoftext|> b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = fresh_path(spark, "tokens")
    token_orc.write_orc(token_orc.encode_sorted(docs, BYTES, 2, 3), path)
    library, start, want = Tokenizer.from_file(BYTES), 0, []
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_orc.checksums(token_orc.positions(spark, path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


def test_scores_are_those_of_the_model(spark):
    dice = random.Random(5)
    texts = [" ".join(dice.choices(["a", "b", "c", "Dd", "e\tf", f"r{dice.randint(0, 60)}"], k=dice.randint(0, 12))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = [[*t.lower().split(), "\n"] for t in texts]
    training = [x for i, x in enumerate(split) if zlib.crc32(str(i).encode()) % 10]
    one, two = {}, {}
    for x in training:
        for i, w in enumerate(x):
            one[w] = one.get(w, 0) + 1
            if i:
                two[x[i - 1], w] = two.get((x[i - 1], w), 0) + 1
    n, v = sum(one.values()), len(one)
    three = {}
    for x in training:
        for gram in zip(x, x[1:], x[2:]):
            three[gram] = three.get(gram, 0) + 1
    for order in (1, 2, 3):
        for r in lm_score.score(docs, order=order).collect():
            x, base, score = split[r.doc_id], 0.0, 0.0
            for i, w in enumerate(x):
                p1 = p = (one.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))
                if order > 1 and i and one.get(x[i - 1], 0):
                    p = (two.get((x[i - 1], w), 0) + 4.0 * p1) / (one[x[i - 1]] + 4.0)
                if order > 2 and i > 1 and two.get((x[i - 2], x[i - 1]), 0):
                    p = (three.get((x[i - 2], x[i - 1], w), 0) + 4.0 * p) / (two[x[i - 2], x[i - 1]] + 4.0)
                base, score = base + np.log10(p1), score + np.log10(p)
            assert (r.n_tokens, r.train_tokens, r.n_known) == (len(x), n, sum(w in one for w in x))
            assert abs(r.base_score - base) < 1e-9 and abs(r.score - score) < 1e-9


def test_groups_of_copies_against_all_pairs(spark, monkeypatch):
    dice = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(3):
        base = dice.choices(words, k=120)
        for share in (0.0, 0.01, 0.02, 0.03, 0.05, 0.1):
            texts += [" ".join(dice.choice(words) if dice.random() < share else w for w in base) for _ in range(8)]
        texts += [" ".join(base[: dice.randint(90, 120)] + dice.choices(words, k=dice.randint(0, 12))) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [{tuple(t.split()[i : i + 3]) for i in range(len(t.split()) - 2)} for t in texts]
    least = list(range(len(texts)))
    for _ in texts:
        before = list(least)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if 100 * len(a & b) >= 90 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
        if before == least:
            break
    for large in (1000, 12):
        monkeypatch.setattr(linking.link, "__defaults__", (large,))
        assert [r.component_id for r in jaccard_join.cluster(docs, 3, 90, 100).orderBy("doc_id").collect()] == least


def test_rows_of_one_id_keep_their_own_text(spark):
    rows = [(1, "alpha one two three\nmore"), (7, "alpha one two three\nsee the first appendix"), (7, "unique line stays here\nnothing like that"), (9, "a b c d e f g h"), (8, "a b c d e f g h"), (9, "quite another text of its own here")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, _gone string, n_lines long")
    got = sorted((r.doc_id, r.text) for r in line_dedup.dedup(docs).collect())
    assert (7, "see the first appendix") in got and (7, "unique line stays here\nnothing like that") in got and len(got) == len(rows)
    kept = sorted((r.doc_id, r.text) for r in jaccard_join.one_of_each(docs, 3, 90, 100).collect())
    assert kept == sorted((i, t) for i, t in rows if (i, t) != (9, "a b c d e f g h"))
