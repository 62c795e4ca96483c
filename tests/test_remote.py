"""Folders, pages and addresses of remote sources, and small parts of synchronisation."""

import base64
import http.server
import json
import threading
from datetime import datetime

from pyspark.sql import functions as F

from spindrift.functions import text
from spindrift.operators import catalog, sync
from spindrift.sources import fetched, office, openapi, remote


def test_folders_of_any_depth(spark):
    rows = []
    for i in range(25):
        rows += [(f"d{i + 1}", f"d{i}", True, f"folder {i + 1}"), (f"f{i}", f"d{i}", False, f"file {i}")]
    rows += [("d3", "d25", True, "back"), ("f24", "d2", False, "file 24"), ("f99", "elsewhere", False, "file 99")]
    entries = spark.createDataFrame([(*r, "u", "2024-01-01T00:00:00Z") for r in rows], "id string, parent string, is_folder boolean, name string, url string, modified string")
    files = remote.folder_files(spark.createDataFrame([("d0",), ("d20",), ("d0",)], "root string"), entries).collect()
    got = sorted((r.root, r.external_id) for r in files)
    # from d20 the way leads back to d3, so all but the first folders are below it too
    assert got == sorted([("d0", f"f{i}") for i in range(25)] + [("d20", f"f{i}") for i in range(3, 25)])


def test_page_texts(spark):
    rich = lambda s: [{"plain_text": s}]
    props = {"Name": {"type": "title", "title": rich("T")}, "Links": {"type": "relation", "relation": []}, "State": {"type": "status", "status": {"name": "open"}}}
    pages = spark.createDataFrame([("p", json.dumps(props)), ("q", None), ("r", "no json")], "page_id string, properties string")
    blocks = spark.createDataFrame([(f"{p}{n}", p, n, "paragraph", json.dumps({"type": "paragraph", "paragraph": {"rich_text": rich(f"line {n}")}})) for p in "pq" for n in range(2)], "block_id string, parent_id string, ordinal int, type string, block string")
    got = {r.page_id: (r.text, r.truncated) for r in remote.page_texts(pages, blocks).collect()}
    assert got == {"p": ("Name: T\nState: open\nline 0\nline 1", False), "q": ("line 0\nline 1", False), "r": ("", False)}
    cut = {r.page_id: (r.text, r.truncated) for r in remote.page_texts(pages, blocks, 13).collect()}
    assert cut["q"] == ("line 0\nline 1", False) and cut["p"] == ("Name: T\nState", True)


def test_page_listing(spark):
    page = {"id": "ab-c", "last_edited_time": "2024-01-02T05:00:00+02:00", "properties": {"x": {"type": "title", "title": [{"plain_text": "Hi"}]}}}
    rows = spark.createDataFrame([(json.dumps(page),), (json.dumps({"id": "z", "url": "u", "last_edited_time": "never"}),)], "page string")
    got = [tuple(r) for r in remote.page_listing(rows).orderBy("external_id").collect()]
    assert got == [("ab-c", "Hi", "https://www.notion.so/abc", datetime(2024, 1, 2, 3)), ("z", remote.UNTITLED, "u", None)]


class Answers(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        body = {"/ok": "# A\n결제".encode(), "/big": b"x" * 999}.get(self.path)
        self.send_response(200 if body else 404)
        self.send_header("Content-Type", "text/plain; charset=utf-8")
        self.end_headers()
        self.wfile.write(body or b"")

    def log_message(self, *_):
        pass


def test_urls(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    rows = spark.createDataFrame([(1, base + "/ok"), (2, base + "/none"), (3, base + "/big"), (4, "file:///etc/hostname"), (5, None), (6, "http://127.0.0.1:1/")], "document_id int, source_url string")
    got = {r.document_id: r for r in fetched.from_urls(rows, max_bytes=100).collect()}
    server.shutdown()
    assert got[1].text == "# A\n결제" and got[1].status == "ok"
    assert {n for n, r in got.items() if r.code == "integration_error"} == {2, 3, 4, 5, 6}


def test_summary_and_lookups(spark):
    actions = spark.createDataFrame([("a", "index"), ("b", "skip"), ("c", "failed"), ("d", "failed"), ("e", "clear")], "document_id string, action string")
    assert tuple(sync.resync_summary(actions).first()) == (5, 1, 1, 2) and sorted(r.document_id for r in sync.failures(actions).collect()) == ["c", "d"]
    past = spark.createDataFrame([("a", "old", "h0", datetime(2024, 1, 1))], "document_id string, action string, content_hash string, created_at timestamp")
    now = actions.withColumn("content_hash", F.lit("h1"))
    both = sync.history(past, now, F.lit("2024-02-01").cast("timestamp"))
    assert both.count() == 6 and [r.action for r in sync.latest_history(both, 1).where("document_id = 'a'").collect()] == ["index"]
    asked = spark.createDataFrame([("a",), ("z",)], "document_id string")
    assert {r.document_id: r.missing for r in catalog.found(actions, asked, "document_id").collect()} == {"a": False, "z": True}
    replaced = sync.replaced(actions, spark.createDataFrame([("a", "new")], "document_id string, action string"), "document_id")
    assert replaced.count() == 5 and replaced.where("action = 'new'").count() == 1
    ends = spark.createDataFrame([("e2", "/b", "GET"), ("e1", "/a", "PUT"), ("e0", "/a", "GET")], "endpoint_id string, path string, method string")
    assert [r.endpoint_id for r in catalog.listed(ends, "endpoints").collect()] == ["e0", "e1", "e2"]
    docs = spark.createDataFrame([("a", "p", datetime(2024, 1, 1)), ("b", "p", datetime(2024, 1, 2)), ("c", "q", datetime(2024, 1, 3))], "document_id string, project string, indexed_at timestamp")
    shown = catalog.list_documents(docs, spark.createDataFrame([("a",), ("a",)], "document_id string"), "p").collect()
    assert [(r.document_id, r.n_endpoints) for r in shown] == [("b", 0), ("a", 2)]
    times = spark.createDataFrame([("2026-07-28T10:00:00.000Z",), ("2026-07-28T10:00:00+09:00",), ("x",), (None,)], "t string")
    assert [r.u for r in times.select(text.utc("t").alias("u")).collect()] == [datetime(2026, 7, 28, 10), datetime(2026, 7, 28, 1), None, None]


def test_yaml_and_base64(spark):
    docs = spark.createDataFrame([(1, '{"a": 1}'), (2, "no: json\n"), (3, "- list"), (4, None)], "document_id int, text string")
    got = {r.document_id: r.text for r in openapi.yaml_as_json(docs).collect()}
    assert json.loads(got[1]) == {"a": 1} and got[3] is None and got[4] is None
    raw = office.packed(spark.createDataFrame([("d.docx", ["x", "y"])], "path string, lines array<string>")).first().content
    rows = spark.createDataFrame([("d.docx", base64.b64encode(raw).decode()), ("e.docx", "no base64!"), ("f.docx", base64.b64encode(b"zz").decode())], "path string, encoded string")
    assert {r.path: r.text for r in office.from_base64(rows).collect()} == {"d.docx": "x\n\ny", "e.docx": None, "f.docx": None}
