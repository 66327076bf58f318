import datetime as dt
import re
import zoneinfo

import pytest
from pyspark.sql import functions as F

from tracefold.functions.instants import with_instant

MON = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ABB = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "JST": 540}


def plain(raw, zone):
    """Brute force with datetime and zoneinfo."""
    if raw is None:
        return None
    t = raw.strip()
    if re.fullmatch(r"\d+(\.\d+)?", t):
        whole, _, frac = t.partition(".")
        n = len(whole.lstrip("0"))
        if n <= 11:
            return int(whole) * 10**6 + int((frac + "000000")[:6])
        if n <= 14:
            return int(whole) * 1000 + int((frac + "000")[:3])
        return int(whole) if n <= 17 else int(whole) // 1000
    u = re.sub(r"\s*\[[^\]]*\]$", "", t)
    clock = r"(?P<h>\d{1,2}):(?P<mi>\d\d)(?::(?P<s>\d\d)(?:[.,](?P<f>\d+))?)?(?: *(?P<ap>AM|PM))?(?: *(?P<z>[A-Z]+|[+-]\d\d:?(?:\d\d)?))?"
    for p in (
        r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})(?:(?:T| +)" + clock + ")?",
        r"(?P<y>\d{4})(?P<m>\d\d)(?P<d>\d\d)T(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)(?:[.,](?P<f>\d+))?(?P<ap>)(?P<z>[A-Z]+|[+-]\d\d:?(?:\d\d)?)?",
        r"(?:[a-z]+, )?(?P<d>\d{1,2}) (?P<m>[a-z]{3}) (?P<y>\d{4}) +" + clock,
        r"(?P<d>\d{1,2})/(?P<m>[a-z]{3})/(?P<y>\d{4}):" + clock,
        r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4})(?: +" + clock + ")?",
        r"(?P<m>\d{1,2})/(?P<d>\d{1,2})/(?P<y>\d{4})(?: +" + clock + ")?",
    ):
        if g := re.fullmatch(p, u, re.I):
            break
    else:
        return None
    g = g.groupdict()
    month = MON.index(g["m"].lower()) + 1 if g["m"][0].isalpha() else int(g["m"])
    h = int(g["h"] or 0)
    if g.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + 12 * (g["ap"].upper() == "PM")
    try:
        wall = dt.datetime(int(g["y"]), month, int(g["d"]), h, int(g["mi"] or 0), int(g["s"] or 0))
    except ValueError:
        return None
    us = int((wall - dt.datetime(1970, 1, 1)) / dt.timedelta(seconds=1)) * 10**6 + int(((g["f"] or "") + "000000")[:6])
    z = (g["z"] or "").upper()
    if z[:1] in ("+", "-"):
        q = z[1:].replace(":", "")
        return us - (1 if z[0] == "+" else -1) * (int(q[:2]) * 60 + int(q[2:] or 0)) * 60 * 10**6
    if z:
        return us - ABB[z] * 60 * 10**6 if z in ABB else None
    zi = zoneinfo.ZoneInfo(zone or "UTC")
    off = wall.replace(tzinfo=zi, fold=0).utcoffset()  # in a gap: the offset before, which moves the time on
    return us - int(off.total_seconds()) * 10**6


CASES = [
    ("2025-10-28T14:00:56.612Z", None), ("2025-02-18t13:05:39.761z", "Asia/Tokyo"), ("Wed, 20 Aug 2025 02:04:48 GMT", None),
    ("2025-05-12T00:08:48.650618-04:00", None), ("20250330T004241.768Z", None), ("2025-10-29T12:03:05,309Z", None),
    ("30.03.2025 02:32:11,398", "Europe/Berlin"), ("26.10.2025 02:30:00,000", "Europe/Berlin"), ("1743295635301812", None),
    ("1743295635301", None), ("1743295635", None), ("1743295635.25", None), ("1743295635301812999", None), ("2025-13-01 08:00:00", None),
    ("2025-02-30 08:00:00", None), ("2025-05-11T23:58-04:00", None), ("2025-11-25T09:08:13.133+05:30[Asia/Kolkata]", None),
    ("2025-10-28T14:01:58.000000247Z", None), ("2025-03-09T03:11:59.2-04", None), ("07/25/2025 12:30:40 AM", "America/New_York"),
    ("11/02/2025 1:30:35 AM", "America/New_York"), ("03/09/2025 2:30:35 AM", "America/New_York"), ("15/Dec/2025:00:34:31 -0300", None),
    ("0000-00-00T00:00:00Z", None), ("null", None), ("", None), ("\t2025-10-01T04:17:22.451Z ", None), ("2025-06-18 06:17:39 EDT", None),
    ("2025-07-03 22:39:03 CEST", None), ("2025-10-28", "Asia/Kolkata"), ("2024-02-29T23:59:59", "No/Such"), ("2025-10-28T24:00:00Z", None),
    ("2025-10-28 14:01:17.747 +0530", None), (None, None), ("13/25/2025 6:30:40 AM", None), ("07/25/2025 13:30:40 PM", None), ("Invalid Date", "UTC"),
    ("x" * 100000, None), ("12" * 40, None),
]


def test_instants_match_brute_force(spark):
    rows = spark.createDataFrame([(i, r, z) for i, (r, z) in enumerate(CASES)], "i int, raw string, zone string")
    got = {r.i: r.us for r in with_instant(rows, F.col("raw"), F.col("zone"), "us").collect()}
    for i, (r, z) in enumerate(CASES):
        assert got[i] == plain(r if r is None or len(r) < 60 else "x", None if z == "No/Such" else z), (r, z)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_instants_match_brute_force_on_tables(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/entries.parquet").select("import_id", "started_at")
    i = spark.read.parquet(f"/root/testdata/{sf}/imports.parquet").select(F.col("id").alias("import_id"), F.get_json_object("log_extensions", "$._timeZone").alias("zone"))
    rows = e.join(i, "import_id", "left").select("started_at", "zone").distinct()
    rows = with_instant(rows, F.col("started_at"), F.col("zone"), "us").collect()
    assert len(rows) > 100
    for r in rows:
        assert r.us == plain(r.started_at, r.zone), r
