"""Waterfalls and reports: requests on a time line, by page or navigation, and the figures around them."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.analysis import status_class
from tracefold.operators.filters import page_matches
from tracefold.operators.hosts import measured
from tracefold.operators.matching import time_range
from tracefold.operators.timestamps import readable_starts
from tracefold.operators.views import host_of, is_navigation
from tracefold.plans.scan import running_sum
from tracefold.plans.shared import Spool


def waterfall(entries: DataFrame, zones: DataFrame, pages: DataFrame, by: str = "page", page: str | None = None, host: str | None = None) -> DataFrame:
    """Entries with a readable start, in groups and in the order of (start, url, id) in each.

    ``by`` is 'page' (entries without one go by navigation), 'navigation' or
    'none'. Output: ``group_no`` (from 1, by earliest start, then name),
    ``group_name``, ``row_no`` (from 1), ``id``, ``import_id``, ``method``, ``url``,
    ``status``, ``start_us``, ``first_us`` (the earliest start of all),
    ``offset_ms`` (whole), ``duration_ms`` (0 where it isn't measured). ``page``
    keeps pages whose id or title holds it, ``host`` one host. A page without a
    row keeps its id as its name.
    """
    if by not in ("page", "navigation", "none"):
        raise ValueError(f"unknown grouping {by!r}")
    spool = Spool(entries.sparkSession)
    titles = pages.select(F.col("id").alias("page_id"), "import_id", "title").dropDuplicates(["page_id", "import_id"])
    cols = entries.select("id", "import_id", "page_id", "started_at", "method", F.coalesce("url", F.lit("<unknown>")).alias("url"), "status", F.coalesce(measured(F.col("time_ms")), F.lit(0.0)).alias("duration_ms"), host_of().alias("host"), F.coalesce(is_navigation(), F.lit(False)).cast("long").alias("nav"))
    rows = readable_starts(cols, zones).join(titles, ["page_id", "import_id"], "left")
    if page is not None:
        rows = rows.where(page_matches(F.col("page_id"), F.col("title"), page))
    if host is not None:
        rows = rows.where(F.lower("host") == host.lower())
    rows = spool.put("rows", rows)
    facts = rows.agg(F.min("start_us").alias("first_us"), F.min("import_id").alias("a"), F.max("import_id").alias("b"))
    many = F.col("a") != F.col("b")
    paged = F.col("page_id").isNotNull() if by == "page" else F.lit(False)
    loose = rows.where(~paged)
    named = rows.where(paged).select("*", F.lit(None).cast("long").alias("session"))
    if by != "none":
        n = running_sum(loose, ["import_id"], ["start_us", "url", "id"], "nav", "earlier")
        first = n.groupBy("import_id").agg(F.min_by("nav", F.struct("start_us", "url", "id")).alias("first_nav"))
        same = F.col("n.import_id").eqNullSafe(F.col("f.import_id"))
        loose = n.alias("n").join(first.alias("f"), same).select(*(F.col(f"n.{c}") for c in rows.columns), (F.col("earlier") + F.col("nav") + 1 - F.col("first_nav")).alias("session"))
    else:
        loose = loose.withColumn("session", F.lit(None).cast("long"))
    all_ = spool.put("grouped", named.unionByName(loose)).join(F.broadcast(facts))  # one row
    key = F.struct(F.when(F.lit(by != "none"), F.col("import_id")).alias("i"), F.when(paged, F.col("page_id")).alias("p"), F.col("session").alias("s"))
    all_ = all_.withColumn("key", key)
    opens = all_.groupBy("key").agg(F.min_by("url", F.struct("start_us", "url", "id")).alias("opening"), F.min("start_us").alias("group_from"), F.min_by("title", F.struct("start_us", "url", "id")).alias("t"), F.min("import_id").alias("any_import"), F.bool_and(many).alias("many"))
    base = F.when(F.col("key.p").isNotNull(), F.coalesce(F.nullif(F.trim("t"), F.lit("")), "key.p")).when(F.col("key.s").isNotNull(), F.concat(F.lit("Navigation "), F.col("key.s").cast("string"), F.lit(": "), F.col("opening"))).otherwise("All Requests")
    opens = opens.withColumn("group_name", F.when(F.col("many") & F.lit(by != "none"), F.concat(F.coalesce(F.col("any_import").cast("string"), F.lit("?")), F.lit(":"), base)).otherwise(base))
    opens = running_sum(spool.put("groups", opens.select("key", "group_name", "group_from", F.lit(1).cast("long").alias("one"), F.to_json("key").alias("tie"))), [], ["group_from", "group_name", "tie"], "one", "before")
    opens = opens.select("key", "group_name", (F.col("before") + 1).alias("group_no"))
    j = all_.join(opens, "key").withColumn("one", F.lit(1).cast("long"))
    j = running_sum(spool.put("joined", j.select("group_no", "group_name", "id", "import_id", "method", "url", "status", "start_us", "first_us", "duration_ms", "one")), ["group_no"], ["start_us", "url", "id"], "one", "before")
    return j.select("group_no", "group_name", (F.col("before") + 1).alias("row_no"), "id", "import_id", "method", "url", "status", "start_us", "first_us", F.expr("(start_us - first_us) div 1000").alias("offset_ms"), "duration_ms")


def unreadable_starts(entries: DataFrame, zones: DataFrame) -> DataFrame:
    """How many entries a waterfall leaves out, as their start can't be read."""
    good = readable_starts(entries.select("id", "import_id", "started_at"), zones).agg(F.count(F.lit(1)).alias("good"))
    return entries.agg(F.count(F.lit(1)).alias("all")).join(F.broadcast(good)).select((F.col("all") - F.col("good")).alias("skipped"))  # one row each


def bar(offset_ms: Column, duration_ms: Column, total_ms: Column, width: int = 60) -> Column:
    """A line of ``width`` characters with the request's place on it: a stroke where it starts, equals signs as long as it lasts."""
    scale = F.when(total_ms > 0, F.lit(float(width)) / total_ms).otherwise(F.lit(0.0))
    start = F.least(F.floor(offset_ms * scale), F.lit(width - 1)).cast("int")
    long_ = F.least(F.greatest(F.round(duration_ms * scale), F.lit(0)), F.lit(width - 1) - start).cast("int")
    return F.rpad(F.concat(F.repeat(F.lit(" "), start), F.lit("|"), F.repeat(F.lit("="), long_)), width, " ")


def waterfall_text(rows: DataFrame, width: int = 60) -> DataFrame:
    """The waterfall as lines: ``group_no``, ``row_no`` (0 is the group's heading), ``line``."""
    total = rows.groupBy("group_no").agg(F.max(F.col("offset_ms") + F.col("duration_ms")).alias("to"), F.min("offset_ms").alias("from"), F.min("group_name").alias("name"))
    head = total.select("group_no", F.lit(0).cast("long").alias("row_no"), F.col("name").alias("line"))
    j = rows.join(total, "group_no")
    line = F.concat_ws(" ", F.lpad(F.concat(F.col("offset_ms").cast("string"), F.lit("ms")), 10, " "), bar(F.col("offset_ms") - F.col("from"), F.col("duration_ms"), F.col("to") - F.col("from"), width), F.coalesce(F.col("status").cast("string"), F.lit("-")), F.coalesce("method", F.lit("-")), "url")
    return head.unionByName(j.select("group_no", "row_no", line.alias("line")))


def top_slowest(entries: DataFrame, k: int = 20) -> DataFrame:
    """The first k entries by time, those without a time last; of these the ones that took any."""
    rows = entries.select("id", "method", "url", "status", "started_at", measured(F.col("time_ms")).alias("ms"))
    return rows.orderBy(F.desc_nulls_last("ms"), F.asc_nulls_first("started_at"), "id").limit(k).where("ms > 0")


def scan_order(entries: DataFrame, k: int | None = None) -> DataFrame:
    """Entries as a scan of the store gives them: by start as text, missing ones first, then id."""
    rows = entries.orderBy(F.asc_nulls_first("started_at"), "id")
    return rows if k is None else rows.limit(k)


def model(entries: DataFrame, zones: DataFrame, pages: DataFrame, top: int = 20, most: int = 500) -> dict[str, list[dict]]:
    """All that a report shows: figures of bounded size, and the first ``most`` requests of the waterfall."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    errors = entries.where("status >= 400").groupBy(host_of().alias("host"), "path").agg(F.count(F.lit(1)).alias("n"), F.min_by("url", F.struct("started_at", "id")).alias("sample_url")).orderBy(F.desc("n"), "host", "path").limit(top)
    w = waterfall(entries, zones, pages)
    return {
        "statuses": rows(entries.groupBy(status_class(F.col("status")).alias("class")).agg(F.count(F.lit(1)).alias("n")).orderBy("class")), "errors": rows(errors), "slowest": rows(top_slowest(entries, top)), "time_range": rows(time_range(entries, zones)),
        "pages": rows(pages.orderBy(F.asc_nulls_first("started_at"), "import_id", "id").select("id", "import_id", "title", "started_at", "on_content_load_ms", "on_load_ms").limit(most)), "waterfall": rows(w.orderBy("start_us", "url", "id").limit(most)),
    }


def script_safe(value) -> str:
    """JSON that may stand inside a script element."""
    t = json.dumps(value, ensure_ascii=False, default=str)
    for c in "<>&  ":
        t = t.replace(c, f"\\u{ord(c):04x}")
    return t


def render_html(report: dict[str, list[dict]], title: str = "Captured traffic") -> str:
    """A report as one HTML page with its data inside."""
    def rows_of(name: str) -> str:
        rows = report[name]
        if not rows:
            return f"<h2>{html.escape(name)}</h2><p>none</p>"
        head = "".join(f"<th>{html.escape(k)}</th>" for k in rows[0])
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r.values()) + "</tr>" for r in rows)
        return f"<h2>{html.escape(name)}</h2><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"

    end = max((r["offset_ms"] + r["duration_ms"] for r in report["waterfall"]), default=0) or 1
    bars = "".join(
        f'<div class="row" title="{html.escape(str(r["url"]), quote=True)}"><span style="margin-left:{100 * r["offset_ms"] / end:.2f}%;width:{max(0.2, 100 * r["duration_ms"] / end):.2f}%"></span></div>' for r in report["waterfall"]
    )
    style = "body{font:14px sans-serif}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px}.row{height:6px}.row span{display:block;height:5px;background:#47a}"
    parts = "".join(rows_of(n) for n in report if n != "waterfall")
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{parts}<h2>waterfall</h2>{bars}<script type="application/json" id="data">{script_safe(report)}</script></body></html>'
