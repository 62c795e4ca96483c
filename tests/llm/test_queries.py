"""The registered queries: against their SQL on the smallest tables, or against plain Python; and the pipeline, stage by stage."""

import os
import random
import re

import duckdb
import public_tokenizers
import pytest
import sentencepiece

from spindrift.llm import quality_rules, sentencepiece_bpe, token_orc, url_filter
from spindrift.llm.common import fresh_path
from spindrift.llm.queries import BYTE_BPE, ORACLES, PIECE_MODEL, QUERIES, URL_RULES

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows = QUERIES[name](spark, DATA)
    columns = sorted(rows.columns)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in cursor.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in rows.collect()) == want


def plain_figures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {r: runs.count(r) for r in set(runs)}
    covered = {i + j for i, r in enumerate(runs) if seen[r] > 1 for j in range(5)}
    repeated = len(covered)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), repeated, len(words) < 10 or 100 * repeated > 20 * len(words)


def test_quality_figures(spark):
    dice = random.Random(6)
    texts = ["".join(dice.choice(["a ", "b ", "word ", "#", "\n", "a b c d e ", "\t", "é ", "💥 "]) for _ in range(dice.randint(0, 80))) for _ in range(150)]
    texts += [None, "", " \n\t ", "same line\nsame line\nsame line", "x " * 12, "one two three four five one two three four five six", "w " * 3000]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, _runs int, n_lines string").drop("n_lines")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in quality_rules.report(docs.select("doc_id", "text")).collect()}
    assert {i: g[:6] for i, g in got.items()} == {i: plain_figures(t) for i, t in enumerate(texts)}
    assert not any(kept for *_, failed, kept in got.values() if failed)


def plain_rule(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in URL_RULES for own, _, prefix in [r.partition("/")] if (host == own or host.endswith("." + own)) and path.startswith("/" + prefix)]
    return host, path, max(fits, key=len, default=None)


def test_url_rules(spark):
    dice = random.Random(3)
    hosts = ["example.net", "a.example.net", "EXAMPLE.com", "x.example.com", "net", "notnet", "b.net", "some.org", "ORG", "Éxample.org", "host"]
    urls = [f"{dice.choice(['http', 'https', ''])}://{dice.choice(hosts)}{dice.choice(['', '/', '/en/', '/en', '/de/x', '/fr/', '/fr/a/b', '//en/'])}{dice.choice(['', '?q=/fr/', '#x://y', '?a#b'])}" for _ in range(400)]
    urls += [None, "", "no scheme", "a://b://c/en/", "http://", "http://" + "a" * 30_000 + ".net/" + "b" * 30_000, urls[0], urls[0]]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.judge(pages, URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule = plain_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict in ({"allow", "block"} if rule is None else {URL_RULES[rule]})


def test_urls_without_a_rule_are_judged_by_their_form(spark):
    """Trees fitted on the labelled hosts tell the urls of hosts that no rule names."""
    dice = random.Random(21)
    bad = lambda host: f"http://{host}/p{dice.randint(10**6, 10**9)}-{dice.randint(1, 99)}?a={dice.randint(1, 9)}&b={dice.randint(10**4, 10**7)}&c=1"
    good = lambda host: f"http://{host}/{dice.choice(['about', 'team', 'news', 'help'])}/{dice.choice(['us', 'all', 'archive', 'index'])}"
    name = lambda: "".join(dice.choices("abcdefgh", k=dice.randint(3, 9)))
    rows = [(bad(f"{name()}.bad.net"), None) for _ in range(150)] + [(good(f"{name()}.good.net"), None) for _ in range(150)]
    rows += [(bad(f"{name()}.net"), "block") for _ in range(100)] + [(good(f"{name()}.net"), "allow") for _ in range(100)]
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, {"bad.net/": "block", "good.net/": "allow"}).collect()}
    held_out = [(got[i], want) for i, (_, want) in enumerate(rows) if want]
    assert sum(a == b for a, b in held_out) >= 0.95 * len(held_out)


def test_long_words_are_merged_as_the_library_does(spark):
    dice = random.Random(1)
    long = ["".join(dice.choices("abcdefghinorstä", k=n)) for n in (sentencepiece_bpe.LONG - 1, sentencepiece_bpe.LONG + 1, 3 * sentencepiece_bpe.LONG)]
    texts = [*long, "short " + long[1] + " end", "a" * 10_000, "数" * 6000 + "\x00", " " * 5000]
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    docs = spark.createDataFrame([(i, t, [9]) for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>")
    rows = sentencepiece_bpe.encode(docs.drop("ids"), PIECE_MODEL)
    assert {r.doc_id: list(r.ids) for r in rows.collect()} == {i: library.encode(t, add_eos=True) for i, t in enumerate(texts)}
    back = sentencepiece_bpe.decode(rows, PIECE_MODEL)
    assert {r.doc_id: r.text for r in back.collect()} == {i: library.decode(library.encode(t, add_eos=True)) for i, t in enumerate(texts)}


def test_lookups_read_few_rows(spark):
    """A lookup by doc_id leaves out the files, stripes and row groups that can't hold it."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20_000)], "doc_id long, text string")
    path = fresh_path(spark, "tokens")
    token_orc.write_orc(token_orc.encode_sorted(docs, BYTE_BPE, 2, 4), path)
    found = token_orc.lookup(spark, path, [777, 15_000])
    assert sorted(r.doc_id for r in found.collect()) == [777, 15_000]
    plan = found._jdf.queryExecution()
    plan.executedPlan().execute().count()
    scans = [n for n in _nodes(plan.executedPlan()) if n.nodeName().startswith("Scan orc")]
    assert len(scans) == 1 and scans[0].metrics().apply("numOutputRows").value() <= 4000  # of 20,000


def _nodes(node):
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        node = node.executedPlan()
    out, rest = [node], node.children()
    for i in range(rest.size()):
        out += _nodes(rest.apply(i))
    return out


@tables
def test_pipeline(spark, tmp_path):
    """Odd rows go through every stage; each keeps the columns and what it should of planted cases."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    dice = random.Random(12)
    vocabulary = ["the", "of", "and", "to", "in", "is", *("".join(dice.choices("aeilnorst", k=dice.randint(3, 9))) for _ in range(900))]
    prose = lambda n: "\n".join(" ".join(dice.choice(vocabulary) for _ in range(12)).capitalize() + "." for _ in range(n))
    passage = " ".join(dice.choice(vocabulary) for _ in range(25))
    base = prose(12)
    near = base.replace(base.split()[40], "changed", 1)
    repeated = "This very line of text stands in many of the documents here."
    texts = {i: prose(12) for i in range(40)}
    texts |= {100: base, 101: base, 102: near, 110: prose(8) + "\n" + passage + "\n" + prose(4), 120: "$$$ ### " * 30, 121: None, 122: "", 123: "few words"}
    texts |= {130 + i: prose(8) + "\n" + repeated for i in range(3)}
    rows = [(i, t, "en", "s" if i % 2 else None, 0 if t is None else len(t), "extra") for i, t in texts.items()]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, label string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        path = f"{folder}/{name.replace(' ', '-')}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "line dedup":
            lines = [r.text for r in docs.collect()]
            assert sum(repeated in t for t in lines) == 1
    assert not ids["quality rules"] & {120, 121, 122, 123} and set(range(40)) <= ids["quality rules"]
    assert len(ids["near duplicates"] & {100, 101, 102}) <= 1 and set(range(40)) <= ids["near duplicates"]
    assert 110 not in ids["decontamination"] and set(range(40)) <= ids["decontamination"]
    assert ids["sentencepiece"] == ids["decontamination"]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in docs.where("doc_id < 5").collect():
        assert list(r.ids) == library.encode(texts[r.doc_id], add_eos=True) and r.n_tokens == len(r.ids)
    whole = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in whole.collect()} == ids["sentencepiece"]
    empty = f"{folder}/none"
    spark.read.parquet(f"{folder}/documents.parquet").where("false").write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
