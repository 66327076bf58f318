"""Whole results on small fixtures, against brute force."""

import random

from pyspark.sql import functions as F
from test_instants import plain

from tracefold.operators import hierarchy, matching, views

STARTS = [
    "2025-03-05T10:00:01.500Z", "2025-03-05T12:00:00.250+02:00", "2025-03-05T10:00:00Z", "2025-03-05T10:00:00.123456Z", "05 Mar 2025 10:00:02 GMT", "03/05/2025 10:00:03", "1741168800",
    "1741168804000", "2025-03-05 19:00:05", "-", "n/a", None, "2025-03-05T05:00:00.250-05:00", "05.03.2025 10:00:06",
]
ZONES = {1: None, 2: "Asia/Tokyo", 3: "America/New_York"}


def captured(spark):
    """Entries in every notation, in a random order, with their instants by brute force."""
    r = random.Random(7)
    rows = [(i, i % 3 + 1, r.choice(STARTS), r.choice([5.0, 2000.0, None, float("nan"), -1.0]), r.choice(["b", "a", None]), r.choice(["GET", "get", "POST"]), r.choice(["text/html; charset=utf-8", "image/png", None]), None if r.random() < 0.8 else "p") for i in range(120)]
    e = spark.createDataFrame(rows, "id long, import_id long, started_at string, time_ms double, url string, method string, response_mime_type string, page_id string")
    zones = spark.createDataFrame(list(ZONES.items()), "import_id long, zone string")
    return e, zones, [(*x, plain(x[2], ZONES[x[1]])) for x in rows]


def test_offsets_of_every_readable_start(spark):
    e, zones, rows = captured(spark)
    rows = [x for x in rows if x[-1] is not None]
    first = {k: min(x[-1] for x in rows if x[1] == k) for k in ZONES}
    assert {(r.id, r.import_id, r.offset_ms) for r in views.offsets(e, zones).collect()} == {(x[0], x[1], (x[-1] - first[x[1]]) // 1000) for x in rows}
    ends = [x[-1] + round((x[3] if x[3] and x[3] > 0 else 0) * 1000) for x in rows]
    assert tuple(matching.time_range(e, zones).first()) == (min(x[-1] for x in rows), max(x[-1] for x in rows), max(ends))


def test_registered_offsets_read_every_notation(spark):
    from tracefold.queries import queries

    store = "/root/testdata/sf0.001"
    e = spark.read.parquet(f"{store}/entries.parquet")
    zones = {r.id: r.zone for r in spark.read.parquet(f"{store}/imports.parquet").select("id", F.get_json_object("log_extensions", "$._timeZone").alias("zone")).collect()}
    us = {r.id: plain(r.started_at, zones.get(r.import_id)) for r in e.select("id", "import_id", "started_at").collect()}
    us = {k: v for k, v in us.items() if v is not None}
    assert {r.id for r in queries()["waterfall_offsets"](spark, store).collect()} == set(us)
    got = queries()["time_range"](spark, store).first()
    assert (got.first_us, got.last_us) == (min(us.values()), max(us.values()))


def test_sessions_follow_the_instant(spark):
    e, zones, rows = captured(spark)
    want, run = set(), {}
    for i, k, _, _, url, method, mime, page, us in sorted((x for x in rows if x[-1] is not None and x[-2] is None), key=lambda x: (x[1], x[-1], x[4] or "<unknown>", x[0])):
        run[k] = run.get(k, 0) + (k not in run or (method.upper() == "GET" and "text/html" in (mime or "")))
        want.add((i, k, run[k]))
    assert {(r.id, r.import_id, r.session) for r in views.navigation_sessions(e, zones).collect()} == want


def test_depth_below_loops_counts_the_steps(spark):
    n = [(1, "x", "y"), (1, "y", "z"), (1, "z", "x"), (1, "b1", "x"), (1, "b2", "b1"), (1, "self", "self"), (1, "top", None), (1, "kid", "top")]
    n += [(1, f"c{i:02d}", f"c{i - 1:02d}" if i else "z") for i in range(21)] + [(2, "b1", "b1"), (2, "b2", "b1"), (2, "a", "b2")]
    h = {(r.s, r.v): r for r in hierarchy.hierarchy(spark.createDataFrame(n, "s int, v string, p string"), "s", "v", "p").collect()}
    assert len(h) == len(n) and [h[1, v].depth for v in ("x", "z", "self", "b1", "b2", "kid")] == [0, 0, 0, 1, 2, 1]
    assert [h[1, f"c{i:02d}"].depth for i in range(21)] == list(range(1, 22))
    assert [(h[2, v].on_loop, h[2, v].depth) for v in ("b1", "b2", "a")] == [("loop", 0), ("below", 1), ("below", 2)]
