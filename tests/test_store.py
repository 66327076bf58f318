"""The store as a whole: loading captures, loading again, merging, pruning, bodies, search, replay, plugins."""

import copy
import gzip
import io
import json
import threading

import pytest
from pyspark.sql import functions as F
from test_core import CAPTURE

from tracefold import config, plugins, replay
from tracefold.functions import bodies, graphql
from tracefold.operators import masking, openapi, report, search, store, tracing
from tracefold.sources import har, sinks
from tracefold.streaming import devtools_events, fold_events, stable


def test_scanner_gives_every_entry():
    doc = {"z": [1, {"log": {"entries": [2]}}], "log": {"a": "}],{\"", "entries": [{"x": "],[{\\", "y": [[], {}]}, {"é": None}], "b": {"entries": [9]}}}
    for size in (1, 5, 1 << 20):
        got = list(har.scan_capture(io.BytesIO(json.dumps(doc, ensure_ascii=False).encode()), chunk=size))
        assert [json.loads(t) for p, t in got if p >= 0] == doc["log"]["entries"]
        assert json.loads(got[-1][1])["log"] == doc["log"] | {"entries": []}
    for bad in ("", "{}", "[1", '{"log":{}}', '{"log":{"entries":[{}]}} 1', '{"log":{"entries":[{}],"entries":[]}}', '{"log":{"entries":[{}'):
        with pytest.raises(ValueError):
            list(har.scan_capture(io.BytesIO(bad.encode())))


def capture(**more):
    c = copy.deepcopy(CAPTURE)
    e = c["log"]["entries"]
    e[1]["_securityDetails"] = {"protocol": "TLS 1.3", "subjectName": "shop", "validTo": 1704067200}
    e[1]["_initiator"] = {"type": "script", "stack": {"callFrames": [], "parent": {"callFrames": [{"url": "u.js", "lineNumber": 3, "columnNumber": 4}]}}}
    e[1]["response"]["headers"] = [{"name": "Content-Encoding", "value": "gzip"}]
    import base64

    e[1]["response"]["content"] = {"size": 5, "mimeType": "application/json", "text": base64.b64encode(gzip.compress(b'{"a": [1, 2.5], "b": null}')).decode(), "encoding": "base64"}
    e.append(copy.deepcopy(e[1]) | more)
    e[2]["request"] = {"method": "POST", "url": "https://shop.example/graphql", "httpVersion": "h2", "headers": [], "postData": {"mimeType": "application/json", "text": '{"query":"query Q { first second }"}'}}
    return c


def test_loading_exporting_and_loading_again(spark, tmp_path):
    f = tmp_path / "a.har"
    f.write_text(json.dumps(capture()))
    at = str(tmp_path / "store")
    first = har.load(spark, [str(f)], at, decompress=True, keep_raw=True).collect()
    assert [(r.id, r.entry_count, r.entries_skipped) for r in first] == [(1, 3, 0)]
    s = store.Store(spark, at)
    e = s.table("entries").orderBy("id").collect()
    assert [r.id for r in e] == [1, 2, 3] and e[1].tls_version == "TLS 1.3" and e[1].tls_cert_expiry == "2024-01-01T00:00:00+00:00" and (e[1].initiator_url, e[1].initiator_line) == ("u.js", 3)
    assert e[1].response_body_size == 26 and e[1].response_body_hash_raw and e[2].graphql_operation_name == "Q" and json.loads(e[2].graphql_top_level_fields) == ["first", "second"]
    assert s.table("graphql_fields").count() == 2 and s.table("blobs").count() == 3 and s.table("pages").count() == 1
    again = har.load(spark, [str(f)], at, incremental=True, decompress=True, keep_raw=True).collect()
    assert [(r.id, r.entry_count, r.entries_skipped) for r in again] == [(2, 0, 3)] and s.table("entries").count() == 3 and s.table("pages").count() == 2
    posts = har.load(spark, [str(f)], str(tmp_path / "posts"), keep=[lambda r: r["method"] == "POST"], change=[lambda r: {"status_text": "seen"}]).collect()
    assert posts[0].entry_count == 1 and store.Store(spark, str(tmp_path / "posts")).table("entries").first().status_text == "seen"
    out = tmp_path / "out.har"
    assert sinks.write_capture(s.table("entries"), s.table("pages"), str(out), s.table("blobs")) == 3
    doc = json.loads(out.read_text())["log"]
    assert doc["entries"][0]["_x"] == 1 and doc["entries"][1]["response"]["content"]["text"] == '{"a": [1, 2.5], "b": null}' and doc["pages"][0]["id"] == "p1"
    (tmp_path / "z.har").write_bytes(gzip.compress(out.read_bytes()))  # told by its first bytes
    assert har.entries_of(har.read_captures(spark, [str(tmp_path / "z.har")])).count() == 3
    with pytest.raises(ValueError):
        har.read_captures(spark, ["x.har.br"])
    assert s.prune([1]) == [] and s.table("entries").count() == 0 and s.table("blobs").count() == 0 and [r.id for r in s.table("imports").collect()] == [2]


def test_required_fields(spark, tmp_path):
    c = capture()
    del c["log"]["entries"][0]["request"]["httpVersion"]
    (tmp_path / "a.har").write_text(json.dumps(c))
    with pytest.raises(Exception, match="request.httpVersion is missing"):
        har.entries_of(har.read_captures(spark, [str(tmp_path / "a.har")])).collect()


def test_merging_twice_changes_nothing(spark):
    t = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in store.SCHEMAS}
    once, twice = store.merge([t]), store.merge([t, t])
    for n in store.SCHEMAS:
        assert once[n].count() == twice[n].count(), n
    filled = t["entries"].withColumn("tls_version", F.lit(None).cast("string"))
    m = store.merge([t | {"entries": filled}, t])
    assert m["entries"].where("tls_version is not null").count() == once["entries"].where("tls_version is not null").count()


def test_bodies(spark, tmp_path):
    z = gzip.compress(b"hello")
    assert bodies.unpack(z, "gzip") == b"hello" and bodies.unpack(gzip.compress(z), "gzip, x-gzip, identity") == b"hello" and bodies.unpack(z, "br") is None and bodies.unpack(z, "gzip", 3) is None and bodies.unpack(b"bad", "gzip") is None and bodies.unpack(None, "gzip") is None
    b = spark.createDataFrame([("ab" * 32, bytearray(b"one"), 3, "text/plain", None), ("cd" * 32, bytearray(b""), 0, None, None)], store.SCHEMAS["blobs"])
    out = bodies.extract(b, str(tmp_path / "files")).collect()
    path = next(r.external_path for r in out if r.external_path)
    assert open(path, "rb").read() == b"one" and path.endswith("/ab/ab/" + "ab" * 32)
    ext = spark.createDataFrame([("h", bytearray(b""), 3, None, path), ("x", bytearray(b""), 3, None, "/etc/hostname")], store.SCHEMAS["blobs"])
    got = {r.hash: bytes(r.content) for r in bodies.with_external(ext, str(tmp_path / "files")).collect()}
    assert got == {"h": b"one", "x": b""}
    p = spark.createDataFrame([([("a b", "c&d"), ("e", None)], None, None), (None, "t", "x"), ([("a", "b")], "", "text/plain")], "p array<struct<name:string,value:string>>, t string, m string")
    assert [r[0] for r in p.select(bodies.form_of(F.col("p"), F.col("t"), F.col("m"))).collect()] == ["a+b=c%26d&e=", "t", None]


def test_graphql_detection(spark):
    d = graphql.detect
    assert d("https://a/x?query=%7Bq%7D", None, None)["fields"] == ["q"] and d("https://a/gql", None, None) is not None and d("https://a/x", "application/json", '{"q":1}') is None
    assert d("https://a/x", "application/x-www-form-urlencoded", "query=mutation+M+%7Bm%7D") == {"type": "mutation", "name": "M", "fields": ["m"]} and d("https://a/x", "application/graphql", "{ z }")["fields"] == ["z"]
    assert d("https://a/x", "application/json", '[{"extensions":{"persistedQuery":{}},"operationName":"P"}]')["name"] == "P"
    rows = spark.createDataFrame([(1, "https://a/graphql", None, None), (2, "https://a", "application/json", '{"query":"{ a a b }"}'), (3, None, None, None)], "id int, u string, m string, b string")
    got = graphql.operations(rows, "id", "u", "m", "b")
    assert {(r.entry_id, r.field) for r in graphql.field_rows(got, "id").collect()} == {(2, "a"), (2, "b")}


def test_search_language(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The Café opened, known slow issue"), (2, "known issue list running"), (3, None), (4, ""), (5, "issue; KNOWN")], "doc_id int, text string")
    i = search.Index(spark, str(tmp_path / "fts"))
    with pytest.raises(ValueError, match="fts-rebuild"):
        i.search("x")
    i.build(docs, "doc_id", "text")
    hits = lambda q: {r.doc for r in i.search(q).collect()}
    assert hits("cafe") == {"1"} and hits("known issue") == {"1", "2", "5"} and hits('"known issue"') == {"2"} and hits("run*") == {"2"} and hits("NEAR(known issue, 0)") == {"2", "5"} and hits("known NEAR/1 issue") == {"1", "2", "5"}
    assert hits("known NOT list") == {"1", "5"} and hits("(cafe OR list) AND issue") == {"1", "2"} and hits("nothing") == set()
    assert [r.snippet for r in i.snippets(i.search("list"), "list", 2).collect()] == ["...[list] running"]
    i.update(spark.createDataFrame([(2, "other words")], "doc_id int, text string"), "doc_id", "text", spark.createDataFrame([(5,)], "doc int"))
    assert hits("known") == {"1"} and hits("other") == {"2"}
    p = search.Index(spark, str(tmp_path / "porter"), "porter").build(docs, "doc_id", "text")
    assert {r.doc for r in p.search("runs").collect()} == {"2"}
    g = search.Index(spark, str(tmp_path / "tri"), "trigram").build(docs, "doc_id", "text")
    assert {r.doc for r in g.search("unnin").collect()} == {"2"}
    with pytest.raises(ValueError):
        search.parse("(a")


def test_masks(spark):
    e = spark.createDataFrame([(1, '{"cookie":"a","x":"1"}', '[{"name":"s","value":"1","path":"/"}]', "https://a/p?Tok=a%20b&q=x+y#f"), (2, None, None, None)], "id int, h string, c string, u string")
    m = masking.mask_params(F.col("u"), ["tok"])
    r = e.select(masking.mask_cookies(F.col("c"), ["*"]).alias("c"), m["url"].alias("u"), m["changed"].alias("n"), m["names"].alias("names"), masking.mask_headers(F.col("h"), masking.DEFAULT_HEADERS).alias("h")).collect()
    assert json.loads(r[0].c) == [{"name": "s", "value": "REDACTED", "path": "/"}] and r[0].u == "https://a/p?Tok=REDACTED&q=x+y#f" and r[0].n == 1 and r[0].names == ["Tok"] and json.loads(r[0].h) == {"cookie": "REDACTED", "x": "1"}
    assert tuple(r[1])[:2] == (None, None)
    t = spark.createDataFrame([("a@b.co 212-555-0100 123-45-6789 4111 1111 1111 1111 4111 1111 1111 1112",), (None,)], "t string")
    assert t.select(masking.mask_personal(F.col("t"), "#")).collect()[0][0] == "# # # # 4111 1111 1111 1112"
    with pytest.raises(ValueError):
        masking.chosen(None, None, None, None, defaults=False)
    with pytest.raises(ValueError):
        masking.check_options(False, force=True)


def test_schemas_merge_in_any_order():
    parts = [openapi.schema_of(v) for v in ({"a": 1, "b": "x"}, {"a": 1.5, "c": [1, "s"]}, {"a": None}, [1], {"c": [None, {"k": 1}]})]
    import itertools

    got = set()
    for order in itertools.permutations(parts):
        out = order[0]
        for p in order[1:]:
            out = openapi.merged(out, p)
        got.add(json.dumps(out, sort_keys=True))
    assert len(got) == 1
    doc = openapi.document([{"path": "/a", "method": "get", "query_names": "q", "request_types": "", "servers": "https://x"}], [{"path": "/a", "method": "get", "status": 200, "response_types": "application/json", "n": 2}], [{"path": "/a", "method": "get", "status": 200, "schema": '{"type": "object"}'}])
    assert doc["paths"]["/a"]["get"]["responses"]["200"]["content"]["application/json"]["schema"] == {"type": "object"} and doc["servers"] == [{"url": "https://x"}]


def test_report_page(spark):
    e, p = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("entries", "pages"))
    zones = spark.createDataFrame([], "import_id long, zone string")
    m = report.model(e, zones, p, 3, 5)
    page = report.render_html(m, "<t>")
    assert len(m["waterfall"]) == 5 and "<title>&lt;t&gt;</title>" in page and "</script><" not in page.split('id="data">')[1].split("</script>")[0]
    assert report.script_safe("</script>") == '"\\u003c/script\\u003e"'
    line = spark.range(1).select(report.bar(F.lit(50.0), F.lit(25.0), F.lit(100.0), 8)).first()[0]
    assert line == "    |== " and report.waterfall(e.limit(0), zones, p).count() == 0


def test_resource_and_documents(spark):
    assert tracing.resource(["a=b"]) == {"service.name": "tracefold", "a": "b"}
    with pytest.raises(ValueError):
        tracing.resource(["nothing"])
    e = spark.read.parquet("/root/testdata/sf0.001/entries.parquet").limit(20)
    docs = tracing.documents(e, spark.createDataFrame([], "import_id long, zone string"))
    body = json.loads(tracing.request_body([r.span for r in docs.collect()], {"service.name": "x"}))
    spans = body["resourceSpans"][0]["scopeSpans"][0]["spans"]
    known = {s["spanId"] for s in spans}
    assert all(s["parentSpanId"] in known for s in spans if "parentSpanId" in s)


def test_replay_and_server(spark):
    e = spark.createDataFrame([(1, "GET", "http://old.example/a?x=1", 200, 3, '{"content-type":"text/plain"}', "h", 1.0), (2, "POST", "http://old.example/b", 200, 0, None, None, 1.0), (3, "GET", "http://old.example/none", 200, 3, None, None, 1.0)], "id long, method string, url string, status int, response_body_size long, response_headers string, response_body_hash string, time_ms double")
    e = e.withColumns({"host": F.lit(None).cast("string"), "started_at": F.lit("2025"), "request_headers": F.lit(None).cast("string"), "request_body_hash": F.lit(None).cast("string"), "response_body_hash_raw": F.lit(None).cast("string")})
    b = spark.createDataFrame([("h", bytearray(b"abc"))], "hash string, content binary")
    s = replay.server(e.where("id < 3"), b, ("127.0.0.1", 0))
    threading.Thread(target=s.serve_forever, daemon=True).start()
    rows = {r.id: r for r in replay.replay(e, None, 2, 50.0, [f"old=127.0.0.1:{s.server_port}"], ["X-A=1"]).collect()}
    s.shutdown()
    assert set(rows) == {1, 3} and rows[1].status == 200 and not rows[1].changed and rows[3].status == 404 and rows[3].changed
    for bad in ("nothing", "=h", "a="):
        with pytest.raises(ValueError):
            replay.host_rules([bad])


def test_plugins(spark, tmp_path):
    e = spark.createDataFrame([(i, f"u{i}") for i in range(6)], "id long, url string")
    prog = tmp_path / "p.py"
    prog.write_text("import sys, json\nfor l in sys.stdin:\n    r = json.loads(l)\n    print(json.dumps({'allow': r['id'] % 2 == 0}), flush=True)\n")
    got = plugins.run(e, [["python", str(prog)]], [lambda r: None if r["id"] == 0 else {"url": "new"}]).orderBy("id").collect()
    assert [(r.id, r.url) for r in got] == [(0, "u0"), (2, "new"), (4, "new")]
    (tmp_path / "bad.py").write_text("import sys; sys.exit(3)")
    for f in (["python", str(tmp_path / "bad.py")], lambda r: "yes"):
        with pytest.raises(Exception):
            plugins.run(e, [f]).collect()
    ps = [plugins.Plugin("a", "filter", lambda r: True), plugins.Plugin("x", "exporter", lambda r: None, enabled=False)]
    assert [p.name for p in plugins.resolve(ps, "import")] == ["a"] and [p.name for p in plugins.resolve(ps, "export", ["x"])] == ["x"] and plugins.resolve(ps, "import", None, ["a"]) == []
    with pytest.raises(ValueError):
        plugins.resolve(ps, "import", ["zz"])


def test_settings_in_layers(tmp_path):
    (tmp_path / "home" / "tracefold").mkdir(parents=True)
    (tmp_path / "home" / "tracefold" / config.NAME).write_text("[report]\ntop = 1\n[redact]\ntoken = 'X'\n")
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / config.NAME).write_text("[report]\ntop = 2\n")
    s = config.settings({"report": {"group": "none", "top": None}}, str(tmp_path / "a" / "b"), str(tmp_path / "home"))
    assert s["report"] == {"top": 2, "waterfall_limit": 500, "group": "none"} and s["redact"]["token"] == "X"
    (tmp_path / "a" / config.NAME).write_text("[nothing]\n")
    with pytest.raises(ValueError, match="nothing"):
        config.settings(None, str(tmp_path / "a"), str(tmp_path / "home"))


def test_recorded_browser_events(spark):
    m = [
        {"method": "Network.requestWillBeSent", "params": {"requestId": "r", "timestamp": 1.0, "request": {"url": "u1", "method": "GET"}}},
        {"method": "Network.requestWillBeSent", "params": {"requestId": "r", "timestamp": 1.5, "request": {"url": "u2", "method": "GET"}, "redirectResponse": {"status": 302}}},
        {"method": "Network.responseReceived", "params": {"requestId": "r", "timestamp": 1.7, "response": {"status": 200}}}, {"method": "Network.loadingFinished", "params": {"requestId": "r", "timestamp": 2.0}}, {"method": "Page.other"},
        {"method": "Network.requestWillBeSent", "params": {"requestId": "s", "timestamp": 3.0, "request": {"url": "u3", "method": "GET"}}},
    ]
    lines = spark.createDataFrame([(i, json.dumps(x)) for i, x in enumerate(m)] + [(99, "no json")], "seq long, message string")
    got = {(r.request_id, r.hop): (r.url, r.status, r.time_ms) for r in fold_events(devtools_events(lines)).collect()}
    assert got == {("r", 1): ("u1", 302, 500.0), ("r", 2): ("u2", 200, 500.0), ("s", 1): ("u3", None, None)}
    assert fold_events(devtools_events(lines), ended_only=True).count() == 2


def test_stability(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    open(a, "w").close()
    grows = {"n": 0}

    def look(p):
        grows["n"] += p == b
        return (grows["n"], 0.0) if p == b else (0, 0.0)

    assert stable([a, b], 0.3, look, most=1.0) == [a] and stable([a, str(tmp_path / "none")], 0.1) == [a]
