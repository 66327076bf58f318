import json

import pytest
from pyspark.sql import functions as F

from tracefold.functions import graphql
from tracefold.operators import filters, hierarchy, hosts, intervals, masking, timestamps, views
from tracefold.plans import sql
from tracefold.plans.scan import running_sum
from tracefold.sources import har, sinks
from tracefold.streaming import fold_events, watch


def test_running_sum_crosses_partitions(spark):
    rows = [("a" if i % 3 else None, i, i % 7) for i in range(500)]
    got = {r.i: r.s for r in running_sum(spark.createDataFrame(rows, "k string, i int, v long"), ["k"], ["i"], "v", "s").collect()}
    run = {}
    for k, i, v in rows:
        assert got[i] == run.get(k, 0)
        run[k] = run.get(k, 0) + v
    assert running_sum(spark.createDataFrame([], "k string, i int, v long"), ["k"], ["i"], "v", "s").count() == 0


def test_hierarchy_shapes(spark):
    n = [(1, f"n{i:03d}", f"n{i - 1:03d}" if i else None) for i in range(40)]  # a chain
    n += [(1, "x", "y"), (1, "y", "z"), (1, "z", "x"), (1, "b1", "x"), (1, "b2", "b1"), (1, "self", "self"), (1, "lost", "nowhere")]
    n += [(2, "n001", None), (2, "kid", "n001"), (None, "q", None), (2, None, None)]
    h = {(r.s, r.v): r for r in hierarchy.hierarchy(spark.createDataFrame(n, "s int, v string, p string"), "s", "v", "p").collect()}
    assert len(h) == len(n) - 2
    assert h[1, "n039"].depth == 39 and h[1, "n039"].root == "n000" and h[1, "n000"].subtree_size == 40 and len(h[1, "n039"].path) == 40
    assert {h[1, v].root for v in ("x", "y", "z", "b1", "b2")} == {"x"} and h[1, "self"].root == "self"
    assert [h[1, v].on_loop for v in ("x", "b2", "lost")] == ["loop", "below", "tree"]
    assert h[1, "lost"].p is None and h[2, "kid"].root == "n001"
    for r in h.values():
        if r.on_loop == "tree" and r.p:
            assert h[r.s, r.p].first_no < r.first_no and r.last_no <= h[r.s, r.p].last_no
    d = hierarchy.descendants(hierarchy.hierarchy(spark.createDataFrame(n, "s int, v string, p string"), "s", "v", "p"), spark.createDataFrame([(1, "n010")], "s int, v string"), "s", "v")
    assert d.count() == 29
    assert hierarchy.hierarchy(spark.createDataFrame([], "s int, v string, p string"), "s", "v", "p").count() == 0


def test_redirect_resolution():
    r = hierarchy.resolve_redirect
    assert r(" HTTPS://A.Example:443/x ", "http://b/") == "https://a.example/x"
    assert r("?q=1", "https://a.example/p/o") == "https://a.example/p/o?q=1"
    assert r("c/d", "https://a.example/p/o") == "https://a.example/p/c/d"
    assert r("", "x") is None and r(None, "x") is None and r("http://[bad", "x") is None


def test_islands(spark):
    rows = [("c", 1, "e", s, t, i) for i, (s, t) in enumerate([(0, 10), (2, 3), (10, 12), (15, 20), (15, 40), (41, 41), (50, 60)])]
    df = spark.createDataFrame(rows, "entity_kind string, import_id int, entity_id string, start_us long, end_us long, id long")
    assert sorted(r.next_entry_id for r in intervals.gaps(df).collect()) == [3, 5, 6]
    assert sorted((r.busy_from_us, r.busy_to_us, r.n_entries) for r in intervals.periods(df).collect()) == [(0, 12, 3), (15, 40, 2), (41, 41, 1), (50, 60, 1)]
    assert intervals.gaps(df.limit(0)).count() == 0


def test_eager_rollup_equals_plain_join(spark):
    left = spark.createDataFrame([(i % 5 if i % 11 else None, f"h{i % 3}", i if i % 4 else None) for i in range(200)], "k int, h string, v long")
    right = spark.createDataFrame([(i % 4, i) for i in range(30)], "k int, w long")
    got = {r.h: (r.n_rows, r.a, r.b) for r in hosts.eager_rollup(left, right, "k", ["h"], {"a": F.col("v")}, {"b": F.col("w")}).collect()}
    plain = left.join(right, "k", "left").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("v", F.lit(0))).alias("a"), F.sum(F.coalesce("w", F.lit(0))).alias("b"))
    assert got == {r.h: (r.n, r.a, r.b) for r in plain.collect()}


def test_dictionary_grows(spark, tmp_path):
    d = timestamps.InstantDictionary(spark, str(tmp_path / "dict"))
    rows = spark.createDataFrame([(1, "2025-01-01 00:00:00", "Asia/Tokyo"), (2, "nope", None), (3, None, None), (4, "2025-01-01 00:00:00", None)], "id int, t string, z string")
    got = {r.id: r.utc_us for r in d.normalise(rows, "t", "z").collect()}
    assert got[4] - got[1] == 9 * 3600 * 10**6 and got[2] is None and got[3] is None
    assert d.extend(rows.select(F.col("t").alias("raw"), F.col("z").alias("zone"))).count() == 3


def test_sizes_bounds_and_names(spark):
    assert [filters.parse_size(x) for x in ("1.5MB", "100k", ".5MB", "1 kib", "unlimited")] == [1572864, 102400, 524288, 1024, None]
    with pytest.raises(ValueError):
        filters.parse_size("many")
    assert filters.time_bound("2025-01-02", end=True) == "2025-01-02T23:59:59.999Z" and filters.time_bound("2025-01-01T02:00:00+02:00") == "2025-01-01T00:00:00.000Z"
    df = spark.createDataFrame([("X-Api-Key",), ("other",)], "n string")
    assert [r[0] for r in df.select(filters.names_match(F.col("n"), ["x-*"])).collect()] == [True, False]


def test_sql_guard(spark):
    t = {"t": spark.createDataFrame([(1,), (2,), (3,)], "a int")}
    assert sql.run_query(spark, "SELECT a FROM t ORDER BY a;", t, limit=1, offset=1).collect()[0].a == 2
    assert sql.single_statement(" select ';' ; ") == "select ';'"
    for bad in ("", "SELECT 1; SELECT 2", "DROP TABLE t", "INSERT INTO t VALUES (1)", "CREATE TABLE z AS SELECT 1"):
        with pytest.raises(Exception):
            sql.run_query(spark, bad, t).collect()
    assert sql.render(["a"], [(1,), (None,)], "csv") == "a\n1\n\"\"\n"


def test_masking(spark):
    df = spark.createDataFrame([('{"authorization":"x","accept":"y"}', "a=1&Token=2&b", "call 555-12-1234 \\1 $"), (None, None, None)], "h string, q string, t string")
    r = df.select(masking.mask_headers(F.col("h"), masking.DEFAULT_HEADERS).alias("h"), masking.mask_params(F.concat(F.lit("http://h/?"), F.col("q")), ["tok*"])["query"].alias("q"), masking.mask_text(F.col("t"), [masking.PATTERNS["ssn"]], "$1").alias("t")).collect()
    assert json.loads(r[0].h) == {"authorization": "REDACTED", "accept": "y"} and r[0].q == "a=1&Token=REDACTED&b=" and r[0].t == "call $1 \\1 $"
    assert r[1].h is None and r[1].q is None


def test_graphql():
    p = graphql.parse
    assert p("{ a: b(x: {y: 1}) { c } d }") == {"type": "query", "name": None, "fields": ["b", "d"]}
    assert p("mutation M($i: In!) @x { ...F ... on T { z } } fragment F on T { q ...F }") == {"type": "mutation", "name": "M", "fields": ["q", "z"]}
    assert p("query A { a } query B { b }", "B")["fields"] == ["b"] and p(None) is None and p("nothing") is None


CAPTURE = {
    "log": {
        "version": "1.2", "pages": [{"id": "p1", "startedDateTime": "2025-01-01T00:00:00.000Z", "title": "T", "pageTimings": {"onLoad": 5}}],
        "entries": [
            {"startedDateTime": "2025-01-01T00:00:00.000Z", "time": 10, "pageref": "p1", "_x": 1, "request": {"method": "GET", "url": "https://Shop.Example/a?x=1", "httpVersion": "h2", "headers": [{"name": "A", "value": "1"}, {"name": "a", "value": "2"}], "_requestId": "r1", "bodySize": -1},
             "response": {"status": 302, "statusText": "Found", "headers": [{"name": "Location", "value": "/b"}], "content": {"size": 0}}, "timings": {"send": 1, "wait": 2, "receive": 3, "dns": -1}},
            {"startedDateTime": "2025-01-01T00:00:01.000Z", "time": 20, "request": {"method": "GET", "url": "https://shop.example/b", "httpVersion": "h2", "headers": [], "_requestId": "r2"},
             "response": {"status": 200, "statusText": "OK", "headers": [], "content": {"size": 5, "mimeType": "text/plain", "text": "aGVsbG8=", "encoding": "base64"}}, "timings": {"send": 1, "wait": 2, "receive": 3}},
        ],
    }
}


def test_capture_files(spark, tmp_path):
    (tmp_path / "a.har").write_text(json.dumps(CAPTURE))
    c = har.read_captures(spark, [str(tmp_path / "a.har")])
    e = har.redirect_parents(har.with_hash(har.entries_of(c))).orderBy("position").collect()
    assert c.count() == 3
    assert [r.host for r in e] == ["shop.example"] * 2 and json.loads(e[0].request_headers) == {"a": "2"} and e[0].dns_ms is None and json.loads(e[0].entry_extensions) == {"_x": 1}
    assert e[0].redirect_url == "/b" and e[1].parent_request_id == "r1" and bytes(e[1].body) == b"hello" and e[0].is_redirect == 1 and len({r.entry_hash for r in e}) == 2
    assert har.pages_of(c).collect()[0].on_load_ms == 5 and har.blobs_of(har.entries_of(c)).count() == 1
    (tmp_path / "bad.har").write_text("[1, 2")
    with pytest.raises(Exception):
        har.entries_of(har.read_captures(spark, [str(tmp_path / "bad.har")])).collect()


def test_sinks_and_streams(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/entries.parquet")
    sinks.write_csv(sinks.tabular(e), str(tmp_path / "csv"))
    sinks.write_jsonl(sinks.tabular(e), str(tmp_path / "jsonl"))
    assert spark.read.json(str(tmp_path / "jsonl")).count() == e.count()
    doc = json.loads(sinks.capture_entries(e).first().entry)
    assert doc["request"]["url"] and "timings" in doc
    pages, zones = spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), spark.createDataFrame([], "import_id long, zone string")
    assert sinks.trace_events(e, zones, pages).count() > 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.har").write_text(json.dumps(CAPTURE))
    got = []
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda paths, b: got.extend(paths), once=True).awaitTermination()
    assert len(got) == 1
    ev = [(1, "r", "sent", 0.0, "u1", "GET", None), (2, "r", "sent", 5.0, "u2", "GET", 302), (3, "r", "received", 6.0, None, None, 200), (4, "r", "finished", 9.0, None, None, None), (5, "s", "sent", 1.0, "u3", "POST", None)]
    rows = {(r.request_id, r.hop): r for r in fold_events(spark.createDataFrame(ev, "seq int, request_id string, kind string, at_ms double, url string, method string, status int")).collect()}
    assert rows["r", 2].time_ms == 4.0 and rows["r", 2].url == "u2" and rows["s", 1].time_ms is None


def test_self_diff_is_empty(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/entries.parquet")
    assert views.ordinal_diff(e, e).count() == 0
    assert views.merge_entries([e, e], ["id"], ["tls_version"]).where("copies <> 2").count() == 0
