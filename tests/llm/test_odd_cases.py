"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns have defined results."""

import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from spindrift.llm import decontaminate, jaccard_join, line_dedup, lm_score, quality_rules, sentencepiece_bpe, substring_dedup, token_orc, url_filter, warc
from spindrift.llm.common import fresh_path

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SHAPE = "doc_id long, text string, lang string, block string, keys string, label string, v long"
LONG = " ".join(f"word{i % 97}" for i in range(6000))
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
TEXTS = [(1, PASSAGE), (2, PASSAGE), (3, None), (4, ""), (5, LONG), (None, PASSAGE), (7, "  \t\n "), (7, "repeated id"), (8, "éa Ünïcode 一 😀 ​x"), (9, PASSAGE + "\n" + PASSAGE)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "b", "k", "l", 5) for i, t in TEXTS], SHAPE)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_decontaminate(spark, docs, none):
    items = spark.createDataFrame([(1, "Beta GAMMA delta epsilon zeta eta theta iota kappa lambda"), (1, "zz"), (2, "repeated id"), (3, None), (None, PASSAGE), (4, "")], "item_id long, text string")
    rows = decontaminate.report(docs, items).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r["items"]))
    assert len(rows) == len(TEXTS)
    assert by[1] == by[2] == [(15, 10, ["1"])]
    assert by[3] == by[4] == [(0, 0, [])]
    assert by[9] == [(30, 20, ["1"])]
    assert by[None] == [(15, 10, ["1"])] and sorted(by[7]) == [(0, 0, []), (2, 2, ["2"])]
    same = docs.sparkSession.createDataFrame([(2, PASSAGE, "a"), (2, "quite clean", "b"), (None, PASSAGE, "c"), (None, "clean too", "d"), (3, PASSAGE, "e"), (3, PASSAGE, "f")], "doc_id long, text string, _key string")
    assert sorted(r.k for r in decontaminate.clean(same.withColumnRenamed("_key", "k"), items).collect()) == ["b", "d"]
    assert sorted((r.n_words, r.n_hit) for r in decontaminate.report(same, items).collect()) == [(2, 0), (2, 0), *[(15, 10)] * 4]
    assert decontaminate.report(none, items).count() == 0
    assert {r.n_hit for r in decontaminate.report(docs, items.where("false")).collect()} == {0}
    assert decontaminate.clean(docs, items).columns == docs.columns


def test_proximity(spark, docs):
    index = decontaminate.build_index(docs.where("doc_id in (1, 8)"))
    assert [(r.doc_id, r.span) for r in decontaminate.proximity(index, ["alpha", "gamma"], 3).collect()] == [(1, 2)]
    assert decontaminate.proximity(index, ["alpha", "omicron"], 3).count() == 0
    assert decontaminate.proximity(index, ["nowhere"], 3).count() == 0


def test_warc(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (3, "u", None), (4, "u", fake + "WARC/1.1\r\n"), (5, "u", "WARC/1.1\r\n"), (6, "u", "x" * 300_000), (None, "u", "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.roundtrip(pages).collect()}
    assert len(got) == len(rows)
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes) == ("revisit", 2, 4)
    assert (got[2].record_type, got[3].payload_bytes) == ("response", 0)
    assert got[4].payload_bytes == len(fake) + 10 and got[5].payload_bytes == 10 and got[6].payload_bytes == 300_000
    assert warc.roundtrip(pages.where("false")).count() == 0


def test_warc_of_others(spark, tmp_path):
    """A long HTTP head, a block without one, and what the records hold."""
    def record(n, block):
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{n}>\r\nWARC-Target-URI: http://h/{n}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    long = b"HTTP/1.1 200 OK\r\n" + b"".join(b"X-%d: %s\r\n" % (i, b"v" * 90) for i in range(300)) + b"\r\n"
    (tmp_path / "a.warc").write_bytes(record(1, long + b"pay\r\n\r\nload") + record(2, b"no head at all") + record(3, b"HTTP/1.1 200 OK\r\n\r\n\xc3\xa9"))
    got = {r.page_id: r for r in warc.read(spark, f"file://{tmp_path}", payloads=True).collect()}
    assert (got[1].url, bytes(got[1].payload), got[1].payload_bytes) == ("http://h/1", b"pay\r\n\r\nload", 11)
    assert (bytes(got[2].payload), got[2].payload_bytes) == (b"", 0) and bytes(got[3].payload) == b"\xc3\xa9"
    for r in got.values():
        assert r.payload_digest == base64.b32encode(hashlib.sha1(bytes(r.payload)).digest()).decode()


def test_jaccard(docs, none):
    got = {}
    for r in jaccard_join.cluster(docs, 3, 90, 100).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert got[1] == [(13, 1)] and got[2] == [(13, 1)] and got[None] == [(13, 1)]
    assert got[3] == [(0, 3)] and sorted(got[7]) == [(0, 7), (1, 7)]
    assert jaccard_join.cluster(none).count() == 0
    assert sorted((r.doc_id or 0) for r in jaccard_join.one_of_each(docs, 3, 90, 100).collect()) == [0, 1, 3, 4, 5, 7, 7, 8, 9]


def test_lm(docs, none):
    rows = lm_score.score(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.score <= 0 for r in rows)
    empty = next(r for r in rows if r.doc_id == 3)
    assert (empty.n_tokens, empty.held_out) == (1, zlib.crc32(b"3") % 10 == 0)
    assert lm_score.score(none).count() == 0


def test_token_orc(spark, docs, none):
    for frame, n in ((docs, len(TEXTS)), (none, 0)):
        path = fresh_path(spark, "t")
        token_orc.write_orc(token_orc.encode_sorted(frame, BYTES, 2, 3), path)
        rows = token_orc.checksums(token_orc.positions(spark, path)).orderBy("start").collect()
        assert len(rows) == n
        at = 0
        for r in rows:
            assert r.start == at
            at += r.n_tokens
        if n:
            assert [r.doc_id for r in rows] == sorted((i for i, _ in TEXTS), key=lambda i: -1 if i is None else i)
            assert {r.ids_crc32 for r in rows if r.doc_id in (3, 4)} == {zlib.crc32(np.array([2], "<u4").tobytes())}
            assert token_orc.lookup(spark, path, [5]).count() == 1


def test_urls(spark):
    rules = {"net/": "block", "a.net/en/": "allow"}
    urls = ["http://x.NET/?q", "http://a.net/en/1", "http://b.a.net/en/", "http://net", "nothing", None, "http://x.org/", "ftp://y.net//#f", "http://xnet/"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert [got[i].rule for i in range(9)] == ["net/", "a.net/en/", "a.net/en/", None, None, None, None, "net/", None]
    assert (got[0].host, got[0].path, got[5].host, got[7].path) == ("x.net", "/", "", "//")
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    assert url_filter.judge(spark.createDataFrame([(1, "http://q/")], "page_id long, url string"), rules).first().verdict == "allow"


def test_lines(spark, docs, none):
    rows = spark.createDataFrame([(1, "Same line of five words.\nother"), (2, "same LINE of five   words\n\n!!"), (3, None), (4, ""), (None, "other"), (5, "other\nother")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup(rows).collect()}
    assert got[1] == ("Same line of five words.\nother", 0) and got[2] == ("\n!!", 1)
    assert got[3] == (None, 0) and got[4] == ("", 0) and got[None] == ("other", 0) and got[5] == ("", 2)
    assert line_dedup.dedup(none).count() == 0
    assert line_dedup.dedup(docs).columns[: len(docs.columns)] == docs.columns
    base = " ".join(f"longer{i}" for i in range(60))
    near = spark.createDataFrame([(1, base), (2, base.replace("longer7 ", "changed "))], "doc_id long, text string")
    assert line_dedup.letters is not None and line_dedup.dedup(near).count() == 2


def test_quality(docs, none):
    rows = quality_rules.report(docs).collect()
    assert len(rows) == len(TEXTS)
    empty = next(r for r in rows if r.doc_id == 3)
    assert (empty.n_words, empty.base_failed, empty.kept) == (0, True, False)
    doubled = next(r for r in rows if r.doc_id == 9)
    assert (doubled.n_words, doubled.n_repeat_words, doubled.n_dup_lines) == (30, 30, 1)
    assert quality_rules.report(none).count() == 0
    assert quality_rules.good(docs).columns == docs.columns


def test_substrings(docs, none):
    rows = substring_dedup.remove_repeats(docs).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed, r.text))
    assert got[1] == [(15, 0, PASSAGE)] and got[2] == [(15, 15, "")] and got[None] == [(15, 15, "")]
    assert got[9] == [(30, 30, "")] and got[3] == [(0, 0, "")] and got[5][0][1] == 0
    assert substring_dedup.remove_repeats(none).count() == 0


def test_pieces(docs, none):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = sentencepiece_bpe.decode(sentencepiece_bpe.encode(docs, PIECES), PIECES).collect()
    want = sorted(hashlib.sha256(repr((own.encode(t or "") + [2], own.decode(own.encode(t or "")))).encode()).hexdigest() for _, t in TEXTS)
    assert sorted(hashlib.sha256(repr((list(r.ids), r.text)).encode()).hexdigest() for r in rows) == want
    assert sentencepiece_bpe.encode(none, PIECES).count() == 0
