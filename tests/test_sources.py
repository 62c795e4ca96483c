"""Mappings of projects to sources, and files to texts."""

import pytest

from spindrift.errors import NotConfigured
from spindrift.operators import catalog, chunks
from spindrift.sources import fetched, mapping, office, openapi

SHAPE = "project string, source_type string, location string, kind string"


def test_mappings(spark):
    rows = lambda *own: spark.createDataFrame(list(own), SHAPE)
    have = rows(("a", "drive", "f1", None))
    seeded = mapping.seeded(have, rows(("a", "drive", "other", None), ("default", "notion", "db", "database"), ("default", "notion", "pg", "page"), ("default", "drive", "", None)))
    assert sorted(map(tuple, seeded.collect())) == [("a", "drive", "f1", None), ("default", "notion", "pg", "page")]
    assert sorted(map(tuple, mapping.upserted(seeded, rows(("a", "drive", "f2", None))).collect()))[0] == ("a", "drive", "f2", None)
    tokens = lambda *own: spark.createDataFrame(list(own), "source_type string, token string")
    assert mapping.resolved(seeded, tokens(("drive", "t"), ("notion", ""))).count() == 1
    plain = mapping.resolved(rows(("a", "notion", "x", None)), tokens(("notion", "t"))).first()
    assert plain.kind == "database"
    asked = spark.createDataFrame([(1, None, None), (2, "a", "drive"), (3, "a", "notion"), (4, "zz", None), (5, None, "notion")], "query_id int, project string, source string")
    good, refused = mapping.answerable(asked, mapping.resolved(seeded, tokens(("drive", "t"))))
    assert sorted(r.query_id for r in good.collect()) == [1, 2] and sorted((r.query_id, r.code) for r in refused.collect()) == [(n, "integration_error") for n in (3, 4, 5)]
    none = mapping.resolved(have.where("false"), tokens(("drive", "t")))
    with pytest.raises(NotConfigured, match="no document source"):
        mapping.require(none, None, None)
    mapping.require(have, "a", "drive")


def test_fetched(spark):
    docx = {v: k for k, v in fetched.BINARY.items()}["docx"]
    packed = office.packed(spark.createDataFrame([("x.docx", ["One", "Two & <b>"])], "path string, lines array<string>")).first().content
    rows = [("t", "text/plain", b"a\x00b" + b"c" * 8), ("exact", "text/plain", b"c" * 10), ("sheet", fetched.NATIVE + "spreadsheet", b"1,2"), ("form", fetched.NATIVE + "form", b"x"), ("img", "image/png", b"x"), ("doc.v1", docx, bytes(packed)), ("bad", docx, b"no archive"), ("big", docx, b"x" * 3000), ("gone", "text/plain", None), ("", "text/plain", b"x")]
    frame = spark.createDataFrame([(i, m, None if c is None else bytearray(c)) for i, m, c in rows], "external_id string, mime_type string, content binary")
    got = {r.external_id: r for r in fetched.texts(frame, max_chars=10, max_bytes=2000).collect()}
    assert len(got) == len(rows)
    assert (got["t"].text, got["t"].truncated) == ("abccccccc", True) and (got["exact"].text, got["exact"].truncated) == ("c" * 10, False)
    assert got["sheet"].text == "1,2" and got["doc.v1"].text == "One\n\nTwo &" and got["doc.v1"].truncated
    assert {i for i, r in got.items() if r.status == "failed"} == {"form", "img", "bad", "big", "gone", ""} and all(r.text is None for r in got.values() if r.status == "failed")
    assert {r.mime_type: r.export_as for r in fetched.export_types(frame).collect()}[fetched.NATIVE + "spreadsheet"] == "text/csv"


API = '{"openapi": "3.0.0", "paths": {"/a/{id}": {"get": {"tags": ["x"], "parameters": [{"name": "id", "in": "path", "schema": {"type": "boolean"}}, {"name": "q", "in": "query", "required": true, "schema": {"type": "array"}}]}, "put": {"requestBody": {"content": {"application/json": {"schema": {"type": "object", "properties": {"k\\"q": {"type": "object", "properties": {"deep": {"type": "object", "properties": {"e": {"example": {"a": [1, "b:c"]}}}}, "none": {"type": "object"}}}, "s": "odd", "n": {"type": "number"}, "u": {}, "m": {"type": "string"}, "cut": {"type": "string"}}}}}}}}, "/b": {"get": {"tags": ["x"]}}}}'


def test_request_samples_and_related(spark):
    ends = openapi.endpoints(spark.createDataFrame([("d", API)], "document_id string, text string"))
    rows = {(r.method, r.path): r for r in catalog.full_details(ends).collect()}
    get, put = rows["GET", "/a/{id}"], rows["PUT", "/a/{id}"]
    assert get.example_code == "curl -X GET 'https://api.example.com/a/True?q=[]'"
    assert put.example_code.endswith("""-d '{"k\\"q": {"deep": {"e": {"a": [1, "b:c"]}}, "none": {}}, "s": "<s>", "n": 0, "u": "<u>", "m": "string"}'""")
    assert [(r.method, r.path) for r in get.related_endpoints] == [("PUT", "/a/{id}"), ("GET", "/b")] and [(r.path) for r in rows["GET", "/b"].related_endpoints] == ["/a/{id}"]
    tagged = ends.select(chunks.tagged_endpoint_text().alias("t")).where("t like 'Tag: x%'")
    assert tagged.count() == 2
    raw = catalog.raw_texts(spark.createDataFrame([("d", API)], "document_id string, raw_text string"), spark.createDataFrame([("d",), ("z",)], "document_id string"))
    assert {r.document_id: (r.raw_text, r.code) for r in raw.collect()} == {"d": (API, None), "z": (None, "document_not_found")}


def test_endpoints_do_not_carry_the_text_of_their_document(spark):
    # a row a path that carried its document's text took as many bytes as paths times text
    docs = spark.createDataFrame([("d", '{"swagger":"2.0","consumes":["a/b"],"produces":["c/d"],"paths":{"/x":{"post":{"parameters":[{"name":"b","in":"body"}],"responses":{"200":{}}}}}}')], "document_id string, text string")
    rows = openapi.endpoints(docs)
    row = rows.first()
    assert (row.request_body.content_type, row.responses[0].content_type) == ("a/b", "c/d")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert all("text#" not in line.partition("Generate posexplode")[2] for line in plan.split("\n"))


def test_related_endpoints_are_the_first_of_all_they_meet(spark):
    # met by tag and by part of the path at once, among more rows of a key than are asked for
    ends = [(n, "GET", f"/{n % 3}/{(n * 7) % 40:02}", [f"t{n % 2}"]) for n in range(40)]
    rows = spark.createDataFrame(ends, "key int, method string, path string, tags array<string>")
    want = {}
    for a in ends:
        near = sorted((b[2], b[1], b[0]) for b in ends if a[0] != b[0] and (set(a[3]) & set(b[3]) or a[2].split("/")[1] == b[2].split("/")[1]))
        want[a[0]] = [k for *_, k in near[:4]]
    found = catalog.related(rows, rows, 4)
    got = {}
    for r in sorted(found.collect(), key=lambda r: r["rank"]):
        got.setdefault(r.asked, []).append(r.key)
    assert got == want
    # no key gives more rows to the join than can be answers
    assert found._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 2
