"""Fixed analytics over the store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.hosts import measured
from tracefold.plans.scan import running_sum
from tracefold.plans.shared import Spool

PHASES = {"total": "time_ms", "ttfb": "wait_ms", "dns": "dns_ms", "connect": "connect_ms", "ssl": "ssl_ms", "send": "send_ms", "receive": "receive_ms"}


def phases_long(entries: DataFrame) -> DataFrame:
    """One row per entry and measured phase: ``phase``, ``value``."""
    pairs = F.explode(F.array(*(F.struct(F.lit(p).alias("phase"), measured(F.col(c)).alias("value")) for p, c in PHASES.items())))
    return entries.select(pairs.alias("x")).select("x.*").where(F.col("value").isNotNull())


def timing_stats(entries: DataFrame) -> DataFrame:
    """Per phase: count, extremes, mean and nearest-rank percentiles (rank round(p * (n - 1))).

    Values are counted first; ranks come from a running sum over the counted
    values, range-sorted, so a phase with billions of rows needs no single task.
    """
    spool = Spool(entries.sparkSession)
    counts = spool.put("counts", phases_long(entries).groupBy("phase", "value").agg(F.count(F.lit(1)).alias("c")))
    base = counts.groupBy("phase").agg(F.sum("c").alias("n"), F.min("value").alias("min_ms"), F.max("value").alias("max_ms"), (F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("avg_ms"))
    ranked = running_sum(counts, ["phase"], ["value"], "c", "before").join(F.broadcast(base.select("phase", "n")), "phase")  # a row per phase
    picks = []
    for p in (50, 90, 95):
        at = F.round(F.lit(p / 100) * (F.col("n") - 1)).cast("long")
        picks.append(F.max(F.when((F.col("before") <= at) & (at < F.col("before") + F.col("c")), F.col("value"))).alias(f"p{p}_ms"))
    return base.join(ranked.groupBy("phase").agg(*picks), "phase").select("phase", "n", "min_ms", "max_ms", F.round("avg_ms", 6).alias("avg_ms"), "p50_ms", "p90_ms", "p95_ms")


def slowest(entries: DataFrame, column: str, least: float, k: int) -> DataFrame:
    """The k slowest entries of at least ``least`` milliseconds, earliest first among equals."""
    rows = entries.select("id", "url", "host", "status", "started_at", measured(F.col(column)).alias("ms")).where(F.col("ms") >= least)
    return rows.orderBy(F.desc("ms"), F.asc_nulls_first("started_at"), "id").limit(k)


def bottleneck(stats: DataFrame) -> DataFrame:
    """The phase with the largest mean and its share of the mean total."""
    order = F.array(*map(F.lit, ["dns", "connect", "ssl", "send", "ttfb", "receive"]))
    part = stats.where(F.col("phase") != "total")
    best = part.agg(F.max_by(F.struct("phase", "avg_ms"), F.struct(F.col("avg_ms"), -F.array_position(order, F.col("phase")))).alias("b"))
    total = stats.where(F.col("phase") == "total").agg(F.max("avg_ms").alias("t"))
    share = F.when(F.col("t") <= 0, F.lit(0.0)).otherwise(F.col("b.avg_ms") / F.col("t"))
    return best.join(F.broadcast(total)).select("b.phase", "b.avg_ms", F.round(share, 6).alias("share"))  # one row each


def connection_reuse(entries: DataFrame) -> DataFrame:
    per = entries.where(F.col("connection_id").isNotNull()).groupBy("connection_id").agg(F.count(F.lit(1)).alias("n"))
    on = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.count(F.lit(1)).alias("connections"), F.count_if(F.col("n") > 1).alias("reused"), F.coalesce(on, F.lit(0)).alias("on_reused")).withColumn(
        "rate", F.round(F.try_divide(F.col("on_reused"), F.col("requests")), 6)
    )


def header(headers: Column, name: str) -> Column:
    return F.get_json_object(headers, f"$.{name}")


def cache_candidate() -> Column:
    """A GET answered 200 with a body and nothing that lets it be kept or checked."""
    control = F.lower(F.coalesce(header(F.col("response_headers"), "cache-control"), F.lit("")))
    bare = F.lit(True)
    for h in ("etag", "last-modified", "expires"):
        bare = bare & header(F.col("response_headers"), h).isNull()
    return (F.upper("method") == "GET") & (F.col("status") == 200) & (F.col("response_body_size") > 0) & ~control.rlike("no-store|no-cache|max-age=0") & bare


def cache_candidates(entries: DataFrame, k: int | None = None) -> DataFrame:
    rows = entries.where(cache_candidate() & F.col("url").isNotNull()).groupBy("url").agg(F.count(F.lit(1)).alias("n"), F.sum("response_body_size").alias("bytes"))
    rows = rows.withColumn("avg_bytes", F.call_function("div", F.col("bytes"), F.col("n")))
    return rows if k is None else rows.orderBy(F.desc("n"), F.desc("bytes"), "url").limit(k)


def status_class(status: Column) -> Column:
    return F.when(status.between(200, 299), "2xx").when(status.between(300, 399), "3xx").when(status.between(400, 499), "4xx").when(status.between(500, 599), "5xx").otherwise("none")


def error_endpoints(entries: DataFrame, k: int | None = None) -> DataFrame:
    """Failures by host and path with the first URL seen."""
    rows = entries.where(F.col("status") >= 400).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.min_by("url", "id").alias("sample_url"))
    return rows if k is None else rows.orderBy(F.desc("n"), "host", "path").limit(k)


def store_stats(entries: DataFrame, imports: DataFrame, blobs: DataFrame) -> DataFrame:
    e = entries.agg(F.count(F.lit(1)).alias("entries"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"), F.count_distinct("host").alias("hosts"))
    unknown = imports.where("entry_count is null").select(F.col("id").alias("import_id"))
    stray = entries.select("import_id").join(unknown, "import_id", "left_semi").agg(F.count(F.lit(1)).alias("stray"))
    i = imports.agg(F.count(F.lit(1)).alias("imports"), F.coalesce(F.sum("entry_count"), F.lit(0)).alias("known")).join(F.broadcast(stray)).select("imports", (F.col("known") + F.col("stray")).alias("counted"))
    b = blobs.agg(F.count(F.lit(1)).alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("blob_bytes"))
    return e.join(F.broadcast(i)).join(F.broadcast(b))  # one row each


def import_listing(imports: DataFrame, entries: DataFrame) -> DataFrame:
    per = entries.groupBy("import_id").agg(F.count(F.lit(1)).alias("n"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"))
    j = imports.join(per, imports.id == per.import_id, "left")
    return j.select("id", "source_file", "status", F.coalesce("entry_count", "n", F.lit(0)).alias("entry_count"), "first_at", "last_at")


def expiry_bound(days: int, now: Column | None = None) -> Column:
    """The UTC text that is ``days`` days (0 to 36500) after ``now`` (text; the current time if not given)."""
    at = F.current_timestamp() if now is None else F.to_timestamp(now)
    return F.date_format(F.to_utc_timestamp(at + F.make_dt_interval(F.lit(min(max(days, 0), 36500))), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def certificates(entries: DataFrame, until: str | Column) -> DataFrame:
    """Distinct certificates that expire up to ``until`` (text, as recorded, or ``expiry_bound``)."""
    d = entries.where(F.col("tls_cert_expiry").isNotNull() & (F.col("tls_cert_expiry") <= until)).select("tls_cert_subject", "tls_cert_issuer", "tls_cert_expiry").distinct()
    return d.agg(F.count(F.lit(1)).alias("expiring"), F.min("tls_cert_expiry").alias("earliest"))


def slow_counts(entries: DataFrame, total: float = 1000, ttfb: float = 500) -> DataFrame:
    """How many entries take at least the given milliseconds, in all and until the first byte."""
    return entries.agg(F.count_if(measured(F.col("time_ms")) >= total).alias("slow_total"), F.count_if(measured(F.col("wait_ms")) >= ttfb).alias("slow_ttfb"))


def cache_totals(entries: DataFrame) -> DataFrame:
    """All candidates as one row: URLs, requests and bytes."""
    return cache_candidates(entries).agg(F.count(F.lit(1)).alias("urls"), F.coalesce(F.sum("n"), F.lit(0)).alias("requests"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def top(entries: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The k most frequent values with their counts, in the order of their names among equals."""
    return entries.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def store_info(entries: DataFrame, imports: DataFrame, blobs: DataFrame) -> DataFrame:
    """The overview as rows of (section, name, value): totals, dates, top hosts, request chains, top initiators."""
    from tracefold.operators.matching import request_chains

    stats = store_stats(entries, imports, blobs).select("entries", "hosts", "imports", "counted", "blobs", "blob_bytes", F.split_part("first_at", F.lit("T"), F.lit(1)).alias("first_date"), F.split_part("last_at", F.lit("T"), F.lit(1)).alias("last_date"))
    long = lambda df, section: df.select(F.lit(section).alias("section"), F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in df.columns))).alias("x")).select("section", "x.name", "x.value")
    named = lambda df, section: df.select(F.lit(section).alias("section"), F.col("value").alias("name"), F.col("n").cast("string").alias("value"))
    return long(stats, "store").unionByName(long(request_chains(entries), "chains")).unionByName(named(top(entries, "host"), "hosts")).unionByName(named(top(entries, "initiator_type"), "initiators"))


def orphan_blobs(blobs: DataFrame, entries: DataFrame) -> DataFrame:
    """Bodies that no entry names in any of its three hash columns."""
    used = entries.select(F.explode(F.array("request_body_hash", "response_body_hash", "response_body_hash_raw")).alias("hash")).where(F.col("hash").isNotNull()).distinct()
    return blobs.select("hash", "size").join(used, "hash", "left_anti")


def blob_savings(entries: DataFrame) -> DataFrame:
    """Per side (request, response): bodies stored once, and bodies and bytes saved by storing equal ones once."""
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_body_hash").alias("hash"), F.col(f"{s}_body_size").alias("size"))
    rows = entries.select(F.explode(F.array(side("request"), side("response"))).alias("b")).select("b.*").where("hash is not null")
    per = rows.groupBy("side", "hash").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    return per.groupBy("side").agg(F.count(F.lit(1)).alias("unique_bodies"), F.sum(F.coalesce("size", F.lit(0))).alias("unique_bytes"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum((F.col("n") - 1) * F.coalesce("size", F.lit(0))).alias("bytes_saved"))
