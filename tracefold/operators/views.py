"""Derived views: waterfall, sessions, phases, spans, differences, merging, API surface."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.hosts import measured
from tracefold.operators.timestamps import readable_starts
from tracefold.plans.scan import running_sum


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, host, port, path and query of an absolute URL; NULL where it is none.

    A regular expression is used since the built-in parser rejects raw blanks
    and braces, which captures do hold.
    """
    p = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?"
    good = url.rlike(p)
    part = lambda k: F.regexp_extract(url, p, k)
    return {
        "scheme": F.when(good, F.lower(part(1))), "host": F.when(good, F.lower(part(2))), "port": F.when(good, F.nullif(part(3), F.lit(""))),
        "path": F.when(good, F.when(part(4) == "", "/").otherwise(part(4))), "query": F.when(good, F.nullif(part(5), F.lit(""))),
    }


def host_of() -> Column:
    """An entry's host, that of its URL where the column is NULL."""
    return F.coalesce(F.col("host"), url_parts(F.col("url"))["host"])


def server_base(url: Column) -> Column:
    """scheme://host with a port that is not the scheme's own."""
    u = url_parts(url)
    own = F.when(u["scheme"] == "http", "80").when(u["scheme"] == "https", "443")
    port = F.when(u["port"].isNotNull() & ~u["port"].eqNullSafe(own), F.concat(F.lit(":"), u["port"])).otherwise("")
    return F.concat(u["scheme"], F.lit("://"), u["host"], port)


def offsets(entries: DataFrame, zones: DataFrame) -> DataFrame:
    """Whole milliseconds of each readable start since the first of its import.

    ``zones`` gives the recording zone of an import, for starts without one.
    """
    rows = readable_starts(entries.select("id", "import_id", "started_at"), zones)
    first = rows.groupBy("import_id").agg(F.min("start_us").alias("first_us"))
    # equal NULLs: entries of no import are offset among themselves
    j = rows.alias("r").join(first.alias("f"), F.col("r.import_id").eqNullSafe(F.col("f.import_id")))
    return j.select("r.id", "r.import_id", F.expr("(start_us - first_us) div 1000").alias("offset_ms"))


def is_navigation() -> Column:
    return (F.upper("method") == "GET") & F.lower(F.coalesce("response_mime_type", F.lit(""))).rlike("text/html|application/xhtml\\+xml")


def navigation_sessions(entries: DataFrame, zones: DataFrame) -> DataFrame:
    """Numbers the navigations among entries without a page, per import in order of (instant, url, id).

    The first such entry opens session 1; entries with an unreadable start are
    in none. ``zones`` gives the recording zone of an import. The running count
    crosses partitions by a carried sum, so an import of any size is spread.
    """
    rows = entries.where(F.col("page_id").isNull()).select("import_id", "started_at", F.coalesce("url", F.lit("<unknown>")).alias("url"), "id", F.coalesce(is_navigation(), F.lit(False)).cast("long").alias("nav"))
    order = ["start_us", "url", "id"]
    n = running_sum(readable_starts(rows, zones).select("import_id", *order, "nav"), ["import_id"], order, "nav", "earlier")
    first = n.groupBy("import_id").agg(F.min_by("nav", F.struct(*order)).alias("first_nav"))
    return n.join(first, "import_id").select("id", "import_id", (F.col("earlier") + F.col("nav") + 1 - F.col("first_nav")).alias("session"))


def phase_layout(entries: DataFrame) -> DataFrame:
    """Start and end of each phase from the entry's start; ssl ends with connect where it fits inside."""
    v = {p: measured(F.col(f"{p}_ms")) for p in ("blocked", "dns", "connect", "ssl", "send", "wait", "receive")}
    z = {p: F.coalesce(c, F.lit(0.0)) for p, c in v.items()}
    nested = v["ssl"].isNotNull() & (z["ssl"] > 0) & v["connect"].isNotNull() & (z["ssl"] <= z["connect"])
    alone = v["ssl"].isNotNull() & v["connect"].isNull()
    t0 = z["blocked"]
    t1 = t0 + z["dns"]
    t2 = t1 + z["connect"] + F.when(alone, z["ssl"]).otherwise(0.0)
    t3, t4 = t2 + z["send"], t2 + z["send"] + z["wait"]
    ends = {"blocked": (F.lit(0.0), t0), "dns": (t0, t1), "connect": (t1, t1 + z["connect"]), "send": (t2, t3), "wait": (t3, t4), "receive": (t4, t4 + z["receive"])}
    rows = [F.when(v[p].isNotNull(), F.struct(F.lit(p).alias("phase"), F.round(a, 6).alias("start_ms"), F.round(b, 6).alias("end_ms"))) for p, (a, b) in ends.items()]
    rows.append(F.when(nested | alone, F.struct(F.lit("ssl").alias("phase"), F.round(F.when(nested, t1 + z["connect"] - z["ssl"]).otherwise(t1), 6).alias("start_ms"), F.round(F.when(nested, t1 + z["connect"]).otherwise(t1 + z["ssl"]), 6).alias("end_ms"))))
    return entries.select("id", F.explode(F.array(*rows)).alias("p")).where(F.col("p").isNotNull()).select("id", "p.phase", "p.start_ms", "p.end_ms")


def ordinals(entries: DataFrame) -> DataFrame:
    """Entries with a URL: METHOD, url and ``nth``, their place among equals in the order of (start, id), from 1.

    Counted by a running sum over range-sorted rows, so a URL with very many
    entries is spread over partitions. NULL starts come first.
    """
    rows = entries.where(F.col("url").isNotNull()).select(
        F.coalesce(F.upper("method"), F.lit("")).alias("method"), "url", "started_at", "id", "status", "response_body_size", measured(F.col("time_ms")).alias("ms"), measured(F.col("wait_ms")).alias("ttfb"), "request_headers", "response_headers", F.lit(1).cast("long").alias("one"),
    )
    return running_sum(rows, ["method", "url"], ["started_at", "id"], "one", "before").withColumn("nth", F.col("before") + 1).drop("one", "before")


def ordinal_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """The n-th request of (METHOD, url) on the left against the n-th on the right.

    Rows that don't differ are left out. A status or size that is missing on one
    side only is a change, times within a millionth are equal, and so is any
    header that differs. Deltas are right less left, NULL where either is missing.
    """
    side = lambda df, t: ordinals(df).select("method", "url", "nth", F.col("status").alias(f"{t}_status"), F.col("response_body_size").alias(f"{t}_size"), F.col("ms").alias(f"{t}_ms"), F.col("ttfb").alias(f"{t}_ttfb"), F.col("request_headers").alias(f"{t}_rq"), F.col("response_headers").alias(f"{t}_rs"), F.lit(1).alias(f"{t}_in"))
    j = side(left, "left").join(side(right, "right"), ["method", "url", "nth"], "full_outer")
    apart = lambda c: F.coalesce(F.abs(F.col(f"left_{c}") - F.col(f"right_{c}")) > 1e-6, F.col(f"left_{c}").isNull() != F.col(f"right_{c}").isNull())
    heads = lambda c: header_changes(F.col(f"left_{c}"), F.col(f"right_{c}")).cast("long")
    j = j.withColumns({"request_header_changes": heads("rq"), "response_header_changes": heads("rs")})
    differs = ~F.col("left_status").eqNullSafe(F.col("right_status")) | ~F.col("left_size").eqNullSafe(F.col("right_size")) | apart("ms") | apart("ttfb") | (F.col("request_header_changes") > 0) | (F.col("response_header_changes") > 0)
    kind = F.when(F.col("left_in").isNull(), "added").when(F.col("right_in").isNull(), "removed").when(differs, "changed")
    return j.withColumn("change", kind).where(F.col("change").isNotNull()).select(
        "change", "method", "url", "nth", "left_status", "right_status", "left_size", "right_size", (F.col("right_size") - F.col("left_size")).alias("size_delta"), F.round(F.col("right_ms") - F.col("left_ms"), 6).alias("ms_delta"),
        F.round(F.col("right_ttfb") - F.col("left_ttfb"), 6).alias("ttfb_delta"), F.when(F.col("change") == "changed", F.col("request_header_changes")).alias("request_header_changes"), F.when(F.col("change") == "changed", F.col("response_header_changes")).alias("response_header_changes"),
    )


def header_changes(a: Column, b: Column) -> Column:
    """How many headers differ, are added or removed between two JSON objects."""
    x, y = (F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in (a, b))
    return F.size(F.filter(F.array_union(F.map_keys(x), F.map_keys(y)), lambda k: ~x[k].eqNullSafe(y[k])))


def merge_entries(stores: list[DataFrame], key: list[str], fill: list[str]) -> DataFrame:
    """Several stores as one: entries equal in ``key`` become one, ``fill`` columns taken from the first that has them."""
    out = None
    for i, s in enumerate(stores):
        s = s.withColumn("__from", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    order = F.struct("__from", "id")
    firsts = [F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), order)).alias(c) for c in fill]
    return out.groupBy(*key).agg(F.min_by("id", order).alias("id"), F.count(F.lit(1)).alias("copies"), *firsts)


def new_entries(incoming: DataFrame, there: DataFrame, key: str = "entry_hash") -> DataFrame:
    """Entries whose hash is neither in the store nor earlier in the batch; those without a hash all count as new."""
    fresh = incoming.join(there.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    known = fresh.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("id").alias("id"))
    return known.select("id").unionByName(fresh.where(F.col(key).isNull()).select("id"))


def first_loads(entries: DataFrame, key: str = "entry_hash") -> DataFrame:
    """What incremental loading of one import after the other keeps: the first entry of each hash by (import, id), and all without one."""
    known = entries.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("id", F.struct("import_id", "id")).alias("id"))
    return known.select("id").unionByName(entries.where(F.col(key).isNull()).select("id"))
