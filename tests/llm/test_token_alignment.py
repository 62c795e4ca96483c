"""Alignment of two tokenizers against their libraries, byte by byte."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from spindrift.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PIECES = ["the", "Zürich", "<|endoftext|>", "</s>", "<0x41>", "  ", "\n", "\n\n", "\t", "don't", "12345", "数据", "😀", ".", "a b", " x", "\r\n", "한국어", "é", "\x00", "internationalisation", "​", " ", "_", "~", "▁"]


def plain(texts):
    """What the contract says, from the libraries' own ids."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in printing} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printing)}
    out, corpus = [], Counter()
    for text in texts:
        links, written, ids = [], [], ([], [])
        if text:
            raw = (" " + text).encode()
            ids = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            own = [bytes(alphabet[c] for c in first.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids[1], map(second.id_to_piece, ids[1]))]
            if any(b"".join(x) != raw for x in own):
                ids = [], []
            else:
                spans = [[(sum(map(len, x[:i])), sum(map(len, x[: i + 1]))) for i in range(len(x))] for x in own]
                links = [(i, j) for i, (s, e) in zip(ids[0], spans[0]) for j, (t, f) in zip(ids[1], spans[1]) if s < f and t < e]
                begin = 0
                for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
                    written.append("|".join(",".join(str(i) for i, (s, e) in zip(x, y) if begin <= s and e <= end) for x, y in zip(ids, spans)))
                    begin = end
        corpus.update(links)
        out.append((len(ids[0]), len(ids[1]), written, links))
    highest = {}
    for (_, j), n in corpus.items():
        highest[j] = max(n, highest.get(j, 0))
    return [(a, b, len(w), len(x), sum(corpus[p] == highest[p[1]] for p in x), sum(corpus[p] for p in x), ";".join(w)) for a, b, w, x in out], corpus


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(8)
    made = ["".join(dice.choice(PIECES[: dice.choice([9, 26])]) + dice.choice(["", " "]) for _ in range(dice.randint(0, 40))) for _ in range(250)]
    return [*made, None, "", " ", "\n", "a▁b", "the cat", "the cat", "x" * 3000, "very long " * 3000, "Line one.\nLine two.\n"]


def test_same_as_libraries(spark, texts):
    want, corpus = plain(texts)
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_a string, pair long").repartition(5)
    got = sorted(tuple(r) for r in token_alignment.align(docs, A, B).collect())
    assert got == [(i, *w) for i, w in enumerate(want)]
    digests = {r.doc_id: r.groups for r in token_alignment.align(docs, A, B, digest=True).collect()}
    assert digests == {i: hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for i, w in enumerate(want)}
    assert {(r.a, r.b): r.n for r in token_alignment.pair_counts(docs, A, B).collect()} == dict(corpus)


def test_forgetting_changes_nothing(texts, monkeypatch):
    """The passes in this process, with a worker that forgets after every batch."""
    monkeypatch.setattr(token_alignment, "SEGMENTS", 30)
    monkeypatch.setattr(token_alignment, "LEFT", 20)
    known = token_alignment.Aligner(A, B)
    counts = Counter()
    for t in texts:
        which, n = known.numbers([t])
        assert len(which) == n.sum()
        uses = [0] * len(known.groups)
        if not known.bad[which].any():
            for x in which.tolist():
                uses[x] += 1
        keys, times = known.counted(token_alignment.np.array(uses, int))
        counts.update(dict(zip(keys.tolist(), times.tolist())))
        if known.full():
            known.thin_out()
    _, corpus = plain(texts)
    assert counts == {j << 32 | i: n for (i, j), n in corpus.items()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "one text"), (4, "one text"), (4, "one text"), (5, None)], "doc_id long, text string")
    rows = [tuple(r) for r in token_alignment.align(docs, A, B).collect()]
    assert len(rows) == 4 and len(set(r[1:] for r in rows)) == 2 and (5, 0, 0, 0, 0, 0, 0, "") in rows
    assert token_alignment.align(docs.where("false"), A, B).count() == 0
