"""All queries of the core with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold import plugins
from tracefold.functions import bodies, graphql
from tracefold.operators import analysis, filters, hierarchy, hosts, intervals, masking, matching, openapi, report, search, timestamps, tracing, views
from tracefold.operators import store as store_ops
from tracefold.plans import forest_sql, instant_sql, more_sql
from tracefold.sources import har, sinks, table

Query = Callable[[SparkSession, str], DataFrame]


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, store: f(table(spark, store, name))


def _two(a: str, b: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, store: f(table(spark, store, a), table(spark, store, b))


def _zoned(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """Entries with the recording zone of each import."""
    return lambda spark, store: f(table(spark, store, "entries"), timestamps.import_zones(spark, store))


def _loads(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    """Entries of imports that are complete against those of all others."""
    def run(spark: SparkSession, store: str) -> DataFrame:
        e, done = table(spark, store, "entries"), table(spark, store, "imports").where("status = 'complete'").select(F.col("id").alias("import_id"))
        return f(e.join(done, "import_id", "left_semi").select(*e.columns), e.join(done, "import_id", "left_anti").select(*e.columns))

    return run


def _tables(spark: SparkSession, store: str) -> dict[str, DataFrame]:
    return {n: table(spark, store, n) for n in store_ops.SCHEMAS}


def _store(f: Callable[[dict[str, DataFrame]], DataFrame]) -> Query:
    return lambda spark, store: f(_tables(spark, store))


def _interrupted(t: dict[str, DataFrame]) -> DataFrame:
    return t["imports"].where("status <> 'complete' OR status IS NULL").select("id")


def _waterfall(f: Callable[[DataFrame], DataFrame], **how) -> Query:
    return lambda s, d: f(report.waterfall(table(s, d, "entries"), timestamps.import_zones(s, d), table(s, d, "pages"), **how))


def _found(query: str) -> Query:
    """A search over an index of all documents."""
    return lambda s, d: search.working_index(s, table(s, d, "documents"), "doc_id", "text").search(query).select(F.col("doc").cast("long").alias("doc_id"), "score")


def _merged(f: Callable[[dict[str, DataFrame], list], DataFrame]) -> Query:
    """The store merged with the same store loaded elsewhere."""
    def run(spark: SparkSession, store: str) -> DataFrame:
        two = [_tables(spark, store), _tables(spark, store)]
        return f(store_ops.merge(two), two)

    return run


def _roundtrip(t: dict[str, DataFrame]) -> DataFrame:
    """Entries written as capture documents and read again."""
    docs = sinks.capture_entries(t["entries"], t["blobs"]).select(F.lit("store").alias("source_file"), F.col("id").alias("position"), F.col("entry").alias("doc"))
    e = har.entries_of(docs, strict=False)
    return e.select(F.col("position").alias("id"), "method", "url", "host", "path", "query_string", "status", "is_redirect", "started_at", "page_id", "dns_ms", "connection_id", F.lower(F.get_json_object("request_headers", "$.user-agent")).alias("agent"), F.sha2("body", 256).alias("body"))


def _requests(t: dict[str, DataFrame]) -> DataFrame:
    sent = t["blobs"].select(F.col("hash").alias("request_body_hash"), F.col("content").cast("string").alias("body"), "mime_type")
    rows = t["entries"].select("id", "url", "request_body_hash").join(sent, "request_body_hash", "left")
    return graphql.operations(rows, "id", "url", "mime_type", "body").select("id", "type", "name", F.size("fields").alias("n_fields"))


def _external(t: dict[str, DataFrame]) -> DataFrame:
    there = t["blobs"].where("size <= 1000")
    files = t["blobs"].withColumn("external_path", F.concat(F.lit("bodies/"), F.col("hash")))
    return store_ops.store_blobs(there, files).select("hash", "size", "mime_type", "external_path", F.octet_length("content").cast("long").alias("held"))


def _unpacked(t: dict[str, DataFrame]) -> DataFrame:
    raw = t["entries"].where("response_body_hash_raw is not null").select("id", F.col("response_body_hash_raw").alias("hash"), F.col("response_body_hash").alias("plain"))
    b = raw.join(t["blobs"].select("hash", "content"), "hash").select("id", "plain", bodies.unpacked(F.col("content"), F.lit("gzip")).alias("content"))
    return b.select("id", F.octet_length("content").cast("long").alias("size"))


def _sql(text: str, *tables: str) -> Query:
    """An ad-hoc statement over the tables it names."""
    def run(spark: SparkSession, store: str) -> DataFrame:
        from tracefold.plans.sql import run_query

        return run_query(spark, text, {t: table(spark, store, t) for t in tables})

    return run


def _filtered(**conditions) -> Query:
    return _on("entries", lambda e: filters.EntryFilter(**conditions).apply(e).select("id", "url", "status"))


def _graphql(e: DataFrame) -> DataFrame:
    return e.where(F.col("graphql_operation_type").isNotNull()).groupBy(F.col("graphql_operation_type").alias("kind"), F.col("graphql_operation_name").alias("name")).agg(F.count(F.lit(1)).alias("n"))


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "p1_found": hierarchy.p1_found,
        "p1_hierarchy": hierarchy.p1_hierarchy,
        "p1_descendants": hierarchy.p1_descendants,
        "p3_found": intervals.p3_found,
        "p3_periods": intervals.p3_periods,
        "p4_found": hosts.p4_found,
        "p4_hosts": hosts.p4_hosts,
        "p7_found": timestamps.p7_found,
        "p7_normalised": timestamps.p7_normalised,
    }
    q |= {
        "slow_total": _on("entries", lambda e: analysis.slowest(e, "time_ms", 1000, 10)),
        "slow_ttfb": _on("entries", lambda e: analysis.slowest(e, "wait_ms", 500, 10)),
        "timing_stats": _on("entries", analysis.timing_stats),
        "bottleneck": _on("entries", lambda e: analysis.bottleneck(analysis.timing_stats(e))),
        "connection_reuse": _on("entries", analysis.connection_reuse),
        "cache_candidates": _on("entries", analysis.cache_candidates),
        "status_classes": _on("entries", lambda e: e.groupBy(analysis.status_class(F.col("status")).alias("class")).agg(F.count(F.lit(1)).alias("n"))),
        "status_histogram": _on("entries", lambda e: e.groupBy("status").agg(F.count(F.lit(1)).alias("n"))),
        "error_endpoints": _on("entries", analysis.error_endpoints),
        "store_stats": lambda s, d: analysis.store_stats(table(s, d, "entries"), table(s, d, "imports"), table(s, d, "blobs")),
        "import_listing": _two("imports", "entries", analysis.import_listing),
        "certificates": _on("entries", lambda e: analysis.certificates(e, "2026-09-01")),
        "orphan_blobs": _two("blobs", "entries", analysis.orphan_blobs),
        "blob_savings": _on("entries", analysis.blob_savings),
        "top_initiators": _on("entries", lambda e: e.where("initiator_type is not null").groupBy("initiator_type").agg(F.count(F.lit(1)).alias("n"))),
        "filter_status_method": _filtered(methods=["GET"], statuses=[404, 500]),
        "filter_url_contains": _filtered(url_contains=["ASSETS/"]),
        "filter_url_regex": _filtered(url_regex=[r"/v[0-9]+/", r"\.css$"]),
        "filter_mime_size": _filtered(mime_contains=["json"], min_response=1000, max_response=4000),
        "filter_dates": _filtered(since="2025-06-01", until="2025-08-31"),
        "filter_extension": _filtered(extensions=["css,js", "png"]),
        "filter_sample": _on("entries", lambda e: filters.stable_sample(e, ["entry_hash", "url", "started_at"], 0.25).select("id")),
        "url_parts": _on("entries", lambda e: e.select("id", *(c.alias(k) for k, c in views.url_parts(F.col("url")).items()), filters.url_extension(F.col("url")).alias("extension"), views.server_base(F.col("url")).alias("server"))),
        "waterfall_offsets": _zoned(views.offsets),
        "navigation_sessions": _zoned(views.navigation_sessions),
        "phase_layout": _on("entries", views.phase_layout),
        "spans": _on("entries", tracing.spans),
        "ordinal_diff": _loads(lambda a, b: views.ordinal_diff(a, b).drop("request_header_changes", "response_header_changes")),
        "header_diff": _loads(lambda a, b: views.ordinal_diff(a, b).where("change = 'changed'").select("method", "url", "nth", "request_header_changes", "response_header_changes")),
        "merge_entries": _loads(lambda a, b: views.merge_entries([a, b], ["method", "url", "started_at", "status"], ["tls_version", "request_id"]).select("method", "url", "started_at", "status", "id", "copies", "tls_version", "request_id")),
        "incremental_new": _on("entries", views.first_loads),
        "new_entries": _loads(lambda a, b: views.new_entries(b, a)),
        "api_operations": _on("entries", openapi.operations),
        "strict_match": _on("entries", lambda e: matching.strict_match(e, e)),
        "fuzzy_match": _loads(lambda a, b: matching.fuzzy_match(b, a)),
        "certificate_list": _on("entries", lambda e: matching.certificate_list(e, "2026-01-01")),
        "request_chains": _on("entries", matching.request_chains),
        "time_range": _zoned(matching.time_range),
        "pages_of_entries": _two("entries", "pages", lambda e, p: e.join(p.select(F.col("id").alias("page_id"), "import_id", "title"), ["page_id", "import_id"], "left").groupBy("import_id", "page_id", "title").agg(F.count(F.lit(1)).alias("n"))),
        "bodies_of_entries": _two("entries", "blobs", lambda e, b: e.where("response_body_hash is not null").select("id", F.col("response_body_hash").alias("hash")).join(b.select("hash", "size", "mime_type"), "hash", "left")),
        "graphql_operations": _on("entries", _graphql),
        "graphql_by_field": _two("entries", "graphql_fields", lambda e, g: e.join(g, e.id == g.entry_id).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 400).alias("failed"))),
        "search_bm25": _found("manifest cookie"),
        "search_boolean": _found("(manifest OR cookie) NOT known"),
        "search_phrase": _found('"known issue"'),
        "search_prefix": _found("normalis*"),
        "search_near": _found("NEAR(known issue, 3)"),
        "search_postings": _on("documents", lambda d: search.postings(d, "doc_id", "text").select("token", "doc_id", "tf", F.element_at("positions", 1).alias("first_at"))),
        "search_stems": _on("eval_items", lambda d: search.postings(d, "item_id", "passage", "porter").groupBy("item_id").agg(F.sum("tf").alias("n_words"), F.count(F.lit(1)).alias("n_stems"))),
        "search_trigrams": _on("eval_items", lambda d: search.postings(d, "item_id", "passage", "trigram").select("token", "item_id", "tf")),
        "search_entries": lambda s, d: search.entries_of_hits(search.working_index(s, table(s, d, "blobs").where(bodies.indexable(F.col("content"), F.col("mime_type"))).select("hash", F.col("content").cast("string").alias("body")), "hash", "body").search("importer OR viewport"), table(s, d, "entries")),
        "search_snippets": lambda s, d: (lambda i: i.snippets(i.search("cookie"), "cookie").select(F.col("doc").cast("long").alias("doc_id"), F.contains("snippet", F.lit("[")).alias("marked")))(search.working_index(s, table(s, d, "documents"), "doc_id", "text")),
        "mask_headers": _on("entries", lambda e: e.select("id", *(F.get_json_object(masking.mask_headers(F.col("request_headers"), ["user-*"]), f"$.{h}").alias(h.replace("-", "_")) for h in ("user-agent", "accept")))),
        "mask_cookies": _on("entries", lambda e: e.select("id", F.get_json_object(masking.mask_cookies(F.col("request_cookies"), ["*"]), "$[0].value").alias("value"), F.get_json_object(masking.mask_cookies(F.col("request_cookies"), ["*"]), "$[0].name").alias("name"))),
        "mask_params": _on("entries", lambda e: (lambda m: e.select("id", m["url"].alias("url"), m["changed"].cast("long").alias("changed")))(masking.mask_params(F.col("url"), ["ts", "c?d"]))),
        "mask_text": _on("documents", lambda d: d.select("doc_id", F.md5(masking.mask_text(F.col("text"), ["[0-9]{3,}", "issue"], "$X")).alias("digest"))),
        "mask_bodies": lambda s, d: masking.redact_bodies(table(s, d, "entries"), table(s, d, "blobs"), ["[0-9]{4}"])[0].select("id", "response_body_hash", "response_body_size", "response_body_hash_raw"),
        "mask_personal": _on("documents", lambda d: d.select("doc_id", F.md5(masking.mask_personal(F.col("text"))).alias("digest"))),
        "redaction_report": _on("entries", lambda e: masking.redaction_report(e, masking.chosen(None, None, ["ts"], None))),
        "pattern_counts": _on("documents", lambda d: masking.pattern_counts(d, "doc_id", "text")),
        "valid_cards": _on("documents", lambda d: masking.valid_cards(d, "doc_id", "text")),
        "pii_findings": _two("entries", "blobs", lambda e, b: masking.findings(e, b)),
        "slow_counts": _on("entries", analysis.slow_counts),
        "cache_totals": _on("entries", analysis.cache_totals),
        "cache_top": _on("entries", lambda e: analysis.cache_candidates(e, 10)),
        "error_top": _on("entries", lambda e: analysis.error_endpoints(e, 10)),
        "top_hosts": _on("entries", lambda e: analysis.top(e, "host")),
        "store_info": lambda s, d: analysis.store_info(table(s, d, "entries"), table(s, d, "imports"), table(s, d, "blobs")),
        "certificates_within": _on("entries", lambda e: analysis.certificates(e, analysis.expiry_bound(90, F.lit("2026-01-01 00:00:00")))),
        "certificates_first": _on("entries", lambda e: matching.certificate_list(e, "2026-01-01", 20)),
        "filter_hosts": _filtered(hosts=["www.tarn-shop.example", "api.tarn-shop.example"]),
        "filter_wildcards": _filtered(url_contains=["v_/", "items%"]),
        "filter_sources": _two("entries", "imports", lambda e, i: filters.from_sources(e, i, None, [".HAR.gz"]).select("id", "import_id")),
        "filter_import": _zoned(lambda e, z: filters.on_import(timestamps.readable_starts(e, z), methods=["post"], statuses=[200, 404]).select("id", "start_us")),
        "filter_diff": _on("entries", lambda e: filters.for_diff(e, methods=["get"], statuses=[500], url_regex=["v2"]).select("id")),
        "filter_replay": _on("entries", lambda e: filters.for_replay(e, statuses=[200]).select("id")),
        "filter_report": _on("entries", lambda e: filters.for_report(e, url_contains=["items"], extensions=["js,css", "png"]).select("id")),
        "filter_pages": _on("pages", lambda p: p.where(filters.page_matches(F.col("id"), F.col("title"), " 1 ")).select("id", "import_id")),
        "scan_first": _on("entries", lambda e: report.scan_order(e.select("id", "started_at", "url"), 100)),
        "top_slowest": _on("entries", report.top_slowest),
        "waterfall": _waterfall(lambda w: w.select("group_no", "row_no", "id", "offset_ms")),
        "waterfall_groups": _waterfall(lambda w: w.groupBy("group_no", "group_name").agg(F.count(F.lit(1)).alias("n"), F.min("offset_ms").alias("from_ms"))),
        "waterfall_none": _waterfall(lambda w: w.select("row_no", "id", "group_name", "offset_ms"), by="none"),
        "waterfall_text": _waterfall(lambda w: report.waterfall_text(w).groupBy("group_no").agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("line")).cast("long").alias("longest"))),
        "unreadable_starts": _zoned(report.unreadable_starts),
        "trace_events": lambda s, d: sinks.trace_events(table(s, d, "entries"), timestamps.import_zones(s, d), table(s, d, "pages")).select("group_no", "turn", F.get_json_object("event", "$.ph").alias("ph"), F.get_json_object("event", "$.dur").cast("long").alias("dur"), F.get_json_object("event", "$.args.id").cast("long").alias("id")),
        "phase_spans": _on("entries", tracing.phase_spans),
        "span_attributes": _on("entries", tracing.attributes),
        "trace_documents": lambda s, d: tracing.documents(table(s, d, "entries"), timestamps.import_zones(s, d)).select("id", "turn", F.get_json_object("span", "$.spanId").alias("span_id"), F.get_json_object("span", "$.startTimeUnixNano").cast("long").alias("start_ns")),
        "api_answers": _on("entries", openapi.answers),
        "api_schemas": _two("entries", "blobs", openapi.schemas),
        "capture_entries": lambda s, d: sinks.capture_entries(table(s, d, "entries"), table(s, d, "blobs")).select("id", *(F.get_json_object("entry", f"$.{p}").alias(k) for k, p in {"url": "request.url", "status": "response.status", "page": "pageref", "body": "response.content.text", "n_headers": "request.headers[1].name", "priority": "_priority"}.items()), F.get_json_object("entry", "$.timings.wait").cast("double").alias("wait")),
        "capture_pages": _on("pages", lambda p: sinks.capture_pages(p, True).select("import_id", "id", F.get_json_object("page", "$.id").alias("ident"), F.get_json_object("page", "$.title").alias("title"))),
        "pages_for_imports": _store(lambda t: store_ops.pages_of_imports(t["pages"], _interrupted(t)).select("id", "import_id", "title")),
        "blobs_by_hash": _store(lambda t: store_ops.blobs_by_hash(t["blobs"], t["entries"].where("status >= 500").select(F.col("response_body_hash").alias("hash"))).select("hash", "size")),
        "insert_pages": _store(lambda t: store_ops.insert_pages(store_ops.pages_of_imports(t["pages"], _interrupted(t)), t["pages"]).select("id", "import_id", "title")),
        "external_blobs": _store(_external),
        "unpacked_bodies": _store(_unpacked),
        "text_bodies": _on("blobs", lambda b: b.select("hash", bodies.text_mime(F.col("mime_type")).alias("text"), bodies.indexable(F.col("content"), F.col("mime_type"), 1000).alias("indexable"), bodies.kept(F.col("content"), F.col("mime_type"), True, True, 500).alias("kept"))),
        "hash_backfill": _on("entries", lambda e: e.select("id", store_ops.entry_hash().alias("v1"), F.coalesce("entry_hash", store_ops.entry_hash()).alias("entry_hash"))),
        "resume_points": _two("imports", "entries", store_ops.resume_points),
        "recount_imports": _two("imports", "entries", lambda i, e: store_ops.recount(i, e).select("id", "entry_count")),
        "prune_entries": _store(lambda t: store_ops.prune(t, _interrupted(t))["entries"].select("id")),
        "prune_blobs": _store(lambda t: store_ops.prune(t, _interrupted(t))["blobs"].select("hash")),
        "prune_fields": _store(lambda t: store_ops.prune(t, _interrupted(t))["graphql_fields"]),
        "merge_store": _merged(lambda m, _: m["entries"].groupBy("import_id").agg(F.count(F.lit(1)).alias("n"), F.count("tls_version").alias("with_tls"))),
        "merge_fields": _merged(lambda m, _: m["graphql_fields"].groupBy("field").agg(F.count(F.lit(1)).alias("n"))),
        "merge_stats": _merged(lambda m, two: store_ops.merge_stats(two, m)),
        "conformed": _on("entries", lambda e: store_ops.conform(e.drop("tls_version", "initiator_line"), "entries").select("id", "tls_version", "initiator_line", "url")),
        "catalog": lambda s, d: store_ops.catalog(s, d).select("table_name", "position", "column_name"),
        "capture_roundtrip": _store(_roundtrip),
        "graphql_requests": _store(_requests),
        "form_pairs": _on("entries", lambda e: e.where("query_string is not null").select("id", F.posexplode(masking.form_pairs(F.col("query_string"))).alias("no", "p")).select("id", "no", "p.name", "p.value")),
        "entries_after_filter_plugin": _on("entries", lambda e: plugins.run(e.select("id", "method", "status"), filters=[lambda row: row["status"] == 404]).select("id")),
        "sql_join_having": _sql("SELECT i.status, count(*) AS n, count(DISTINCT e.host) AS hosts FROM entries e JOIN imports i ON i.id = e.import_id GROUP BY i.status HAVING count(*) > 5", "entries", "imports"),
        "sql_window": _sql("SELECT import_id, id, r FROM (SELECT import_id, id, row_number() OVER (PARTITION BY import_id ORDER BY id DESC) AS r FROM entries) t WHERE r <= 3", "entries"),
        "sql_sets": _sql("(SELECT request_body_hash AS h FROM entries UNION SELECT response_body_hash FROM entries) EXCEPT SELECT hash FROM blobs", "entries", "blobs"),
        "sql_rollup": _sql("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem"),
        "sql_subquery": _sql("SELECT o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) GROUP BY o_orderpriority", "orders", "lineitem"),
        "sql_like": _sql("SELECT id FROM entries WHERE url LIKE '%/ITEMS/%' AND path GLOB '/*/v2*'", "entries"),
        "sql_listagg": _sql("SELECT import_id, listagg(DISTINCT method, ',') WITHIN GROUP (ORDER BY method) AS methods FROM entries GROUP BY import_id", "entries"),
        "sql_recursive": _sql("WITH RECURSIVE n (k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 20) SELECT k, (SELECT count(*) FROM entries WHERE import_id = k) AS n FROM n", "entries"),
        "sql_frames": _sql("SELECT id, sum(status) OVER (PARTITION BY import_id ORDER BY id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS s, lag(id) OVER (PARTITION BY import_id ORDER BY id) AS before, dense_rank() OVER (PARTITION BY import_id ORDER BY status) AS r FROM entries", "entries"),
        "sql_outer": _sql("SELECT e.id, p.title FROM (SELECT * FROM entries WHERE status = 500) e FULL OUTER JOIN pages p ON p.id = e.page_id AND p.import_id = e.import_id", "entries", "pages"),
        "sql_json": _sql("SELECT id, get_json_object(response_headers, '$.server') AS server FROM entries WHERE get_json_object(response_headers, '$.server') IS NOT NULL", "entries"),
    }
    return q


_HOST = "nullif(regexp_replace(lower(host), '\\.$', ''), '')"
_M = lambda c: f"CASE WHEN NOT isnan({c}) AND {c} >= 0 THEN {c} END"
_LONG = " UNION ALL ".join(f"SELECT '{p}' AS phase, {_M(c)} AS value FROM entries" for p, c in analysis.PHASES.items())
_STATS = f"""WITH a AS ({_LONG}), v AS (SELECT * FROM a WHERE value IS NOT NULL),
  r AS (SELECT phase, value, row_number() OVER (PARTITION BY phase ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY phase) AS n FROM v),
  t AS (SELECT phase, n, min(value) AS min_ms, max(value) AS max_ms, round(avg(value), 6) AS avg_ms,
    max(value) FILTER (WHERE k = CAST(round(CAST(0.5 AS DOUBLE) * (n - 1)) AS BIGINT)) AS p50_ms, max(value) FILTER (WHERE k = CAST(round(CAST(0.9 AS DOUBLE) * (n - 1)) AS BIGINT)) AS p90_ms,
    max(value) FILTER (WHERE k = CAST(round(CAST(0.95 AS DOUBLE) * (n - 1)) AS BIGINT)) AS p95_ms FROM r GROUP BY phase, n)"""
_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?"
_PART = lambda k: f"regexp_extract(url, '{_URL}', {k})"
_GOOD = f"regexp_matches(url, '{_URL}')"
_PATH = f"CASE WHEN {_GOOD} THEN coalesce(nullif({_PART(4)}, ''), '/') END"
_SERVER = f"""CASE WHEN {_GOOD} THEN lower({_PART(1)}) || '://' || lower({_PART(2)}) || CASE WHEN {_PART(3)} <> '' AND NOT (lower({_PART(1)}) = 'http' AND {_PART(3)} = '80')
  AND NOT (lower({_PART(1)}) = 'https' AND {_PART(3)} = '443') THEN ':' || {_PART(3)} ELSE '' END END"""
_LAST = r"split_part(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/', -1)"
_EXT = f"CASE WHEN contains({_LAST}, '.') THEN lower(split_part({_LAST}, '.', -1)) END"
_NAV = "upper(method) = 'GET' AND regexp_matches(lower(coalesce(response_mime_type, '')), 'text/html|application/xhtml\\+xml')"
_CANDIDATE = """upper(method) = 'GET' AND status = 200 AND response_body_size > 0 AND url IS NOT NULL
  AND NOT regexp_matches(lower(coalesce(response_headers::JSON->>'$."cache-control"', '')), 'no-store|no-cache|max-age=0')
  AND response_headers::JSON->>'$.etag' IS NULL AND response_headers::JSON->>'$."last-modified"' IS NULL AND response_headers::JSON->>'$.expires' IS NULL"""
_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '')"


def oracle_sql() -> dict[str, str]:
    p = {x: f"({_M(x + '_ms')})" for x in ("blocked", "dns", "connect", "ssl", "send", "wait", "receive")}
    z = {x: f"coalesce({c}, 0.0)" for x, c in p.items()}
    alone, nested = f"({p['ssl']} IS NOT NULL AND {p['connect']} IS NULL)", f"({p['ssl']} > 0 AND {p['ssl']} <= {p['connect']})"
    half = lambda k: f"SELECT upper(method) AS method, url, row_number() OVER (PARTITION BY upper(method), url ORDER BY started_at NULLS FIRST, id) AS nth, status, response_body_size AS size, {_M('time_ms')} AS ms FROM entries WHERE url IS NOT NULL AND import_id % 2 = {k}"
    kept = lambda cond: f"SELECT id, url, status FROM entries WHERE {cond}"
    return {
        "p1_found": forest_sql.FOUND,
        "p1_hierarchy": forest_sql.HIERARCHY,
        "p1_descendants": forest_sql.DESCENDANTS,
        "p3_found": instant_sql.GAPS,
        "p3_periods": instant_sql.PERIODS,
        "p7_found": instant_sql.FOUND,
        "p7_normalised": instant_sql.NORMALISED,
        "p4_found": f"SELECT {_HOST} AS host FROM entries GROUP BY 1 HAVING host IS NOT NULL AND count(*) * 40 >= (SELECT count(*) FROM entries)",
        "p4_hosts": """SELECT nullif(regexp_replace(lower(e.host), '\\.$', ''), '') AS host, count(*) AS n_entries,
  CAST(coalesce(sum(e.response_body_size) FILTER (WHERE e.response_body_size >= 0), 0) AS BIGINT) AS body_bytes,
  CAST(coalesce(sum(CASE WHEN i.status = 'complete' THEN 1 ELSE 0 END), 0) AS BIGINT) AS entries_of_complete_imports
FROM entries e LEFT JOIN imports i ON i.id = e.import_id GROUP BY 1""",
        "slow_total": f"SELECT id, url, host, status, started_at, {_M('time_ms')} AS ms FROM entries WHERE {_M('time_ms')} >= 1000 ORDER BY ms DESC, started_at NULLS FIRST, id LIMIT 10",
        "slow_ttfb": f"SELECT id, url, host, status, started_at, {_M('wait_ms')} AS ms FROM entries WHERE {_M('wait_ms')} >= 500 ORDER BY ms DESC, started_at NULLS FIRST, id LIMIT 10",
        "timing_stats": f"{_STATS} SELECT * FROM t",
        "bottleneck": f"{_STATS} SELECT phase, avg_ms, round(avg_ms / (SELECT avg_ms FROM t WHERE phase = 'total'), 6) AS share FROM t WHERE phase <> 'total' ORDER BY avg_ms DESC LIMIT 1",
        "connection_reuse": """WITH c AS (SELECT connection_id, count(*) AS n FROM entries WHERE connection_id IS NOT NULL GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS requests, count(*) AS connections, count(*) FILTER (WHERE n > 1) AS reused, CAST(sum(n) FILTER (WHERE n > 1) AS BIGINT) AS on_reused,
  round(CAST(sum(n) FILTER (WHERE n > 1) AS DOUBLE) / sum(n), 6) AS rate FROM c""",
        "cache_candidates": f"SELECT url, count(*) AS n, CAST(sum(response_body_size) AS BIGINT) AS bytes, CAST(sum(response_body_size) // count(*) AS BIGINT) AS avg_bytes FROM entries WHERE {_CANDIDATE} GROUP BY url",
        "cache_totals": f"SELECT count(*) AS urls, CAST(coalesce(sum(n), 0) AS BIGINT) AS requests, CAST(coalesce(sum(b), 0) AS BIGINT) AS bytes FROM (SELECT url, count(*) AS n, sum(response_body_size) AS b FROM entries WHERE {_CANDIDATE} GROUP BY url)",
        "cache_top": f"SELECT url, count(*) AS n, CAST(sum(response_body_size) AS BIGINT) AS bytes, CAST(sum(response_body_size) // count(*) AS BIGINT) AS avg_bytes FROM entries WHERE {_CANDIDATE} GROUP BY url ORDER BY n DESC, bytes DESC, url LIMIT 10",
        "status_classes": "SELECT CASE status // 100 WHEN 2 THEN '2xx' WHEN 3 THEN '3xx' WHEN 4 THEN '4xx' WHEN 5 THEN '5xx' ELSE 'none' END AS class, count(*) AS n FROM entries GROUP BY 1",
        "status_histogram": "SELECT status, count(*) AS n FROM entries GROUP BY status",
        "error_endpoints": "SELECT host, path, count(*) AS n, arg_min(url, id) AS sample_url FROM entries WHERE status >= 400 GROUP BY host, path",
        "import_listing": "SELECT i.id, i.source_file, i.status, coalesce(i.entry_count, count(e.id)) AS entry_count, min(e.started_at) AS first_at, max(e.started_at) AS last_at FROM imports i LEFT JOIN entries e ON e.import_id = i.id GROUP BY i.id, i.source_file, i.status, i.entry_count",
        "certificates": "SELECT count(*) AS expiring, min(tls_cert_expiry) AS earliest FROM (SELECT DISTINCT tls_cert_subject, tls_cert_issuer, tls_cert_expiry FROM entries WHERE tls_cert_expiry <= '2026-09-01')",
        "orphan_blobs": "SELECT hash, size FROM blobs b WHERE hash NOT IN (SELECT request_body_hash FROM entries WHERE request_body_hash IS NOT NULL UNION SELECT response_body_hash FROM entries WHERE response_body_hash IS NOT NULL UNION SELECT response_body_hash_raw FROM entries WHERE response_body_hash_raw IS NOT NULL)",
        "top_initiators": "SELECT initiator_type, count(*) AS n FROM entries WHERE initiator_type IS NOT NULL GROUP BY 1",
        "filter_status_method": kept("method = 'GET' AND status IN (404, 500)"),
        "filter_url_contains": kept("url ILIKE '%assets/%'"),
        "filter_url_regex": kept(r"regexp_matches(url, '/v[0-9]+/') OR regexp_matches(url, '\.css$')"),
        "filter_mime_size": kept("response_mime_type ILIKE '%json%' AND coalesce(response_body_size, 0) BETWEEN 1000 AND 4000"),
        "filter_dates": kept("started_at >= '2025-06-01T00:00:00.000Z' AND started_at <= '2025-08-31T23:59:59.999Z'"),
        "filter_extension": kept(f"{_EXT} IN ('css', 'js', 'png')"),
        "url_parts": f"SELECT id, CASE WHEN {_GOOD} THEN lower({_PART(1)}) END AS scheme, CASE WHEN {_GOOD} THEN lower({_PART(2)}) END AS host, CASE WHEN {_GOOD} THEN nullif({_PART(3)}, '') END AS port, {_PATH} AS path, CASE WHEN {_GOOD} THEN nullif({_PART(5)}, '') END AS query, {_EXT} AS extension, {_SERVER} AS server FROM entries",
        "waterfall_offsets": instant_sql.OFFSETS,
        "navigation_sessions": instant_sql.SESSIONS,
        "phase_layout": " UNION ALL ".join(
            f"SELECT id, '{ph}' AS phase, round({a}, 6) AS start_ms, round({b}, 6) AS end_ms FROM entries WHERE {cond}"
            for t1 in [f"({z['blocked']} + {z['dns']})"]
            for t2 in [f"({t1} + {z['connect']} + CASE WHEN {alone} THEN {z['ssl']} ELSE 0.0 END)"]
            for ph, a, b, cond in [
                ("blocked", "CAST(0 AS DOUBLE)", z["blocked"], f"{p['blocked']} IS NOT NULL"), ("dns", z["blocked"], t1, f"{p['dns']} IS NOT NULL"), ("connect", t1, f"{t1} + {z['connect']}", f"{p['connect']} IS NOT NULL"),
                ("send", t2, f"{t2} + {z['send']}", f"{p['send']} IS NOT NULL"), ("wait", f"{t2} + {z['send']}", f"{t2} + {z['send']} + {z['wait']}", f"{p['wait']} IS NOT NULL"),
                ("receive", f"{t2} + {z['send']} + {z['wait']}", f"{t2} + {z['send']} + {z['wait']} + {z['receive']}", f"{p['receive']} IS NOT NULL"),
                ("ssl", f"CASE WHEN {nested} THEN {t1} + {z['connect']} - {z['ssl']} ELSE {t1} END", f"CASE WHEN {nested} THEN {t1} + {z['connect']} ELSE {t1} + {z['ssl']} END", f"{nested} OR {alone}"),
            ]
        ),
        "certificate_list": "SELECT DISTINCT host, tls_cert_subject, tls_cert_issuer, tls_cert_expiry, tls_version, tls_cipher_suite, tls_cert_expiry <= '2026-01-01' AS expired FROM entries WHERE tls_cert_expiry IS NOT NULL",
        "request_chains": "SELECT count(*) AS entries, count(request_id) AS with_request_id, count(parent_request_id) AS with_parent, count(initiator_type) AS with_initiator, count(redirect_url) AS with_redirect FROM entries",
        "time_range": instant_sql.TIME_RANGE,
        "pages_of_entries": "SELECT e.import_id, e.page_id, p.title, count(*) AS n FROM entries e LEFT JOIN pages p ON p.id = e.page_id AND p.import_id = e.import_id GROUP BY 1, 2, 3",
        "bodies_of_entries": "SELECT e.id, e.response_body_hash AS hash, b.size, b.mime_type FROM entries e LEFT JOIN blobs b ON b.hash = e.response_body_hash WHERE e.response_body_hash IS NOT NULL",
        "graphql_operations": "SELECT graphql_operation_type AS kind, graphql_operation_name AS name, count(*) AS n FROM entries WHERE graphql_operation_type IS NOT NULL GROUP BY 1, 2",
        "graphql_by_field": "SELECT g.field, count(*) AS n, count(*) FILTER (WHERE e.status >= 400) AS failed FROM entries e JOIN graphql_fields g ON g.entry_id = e.id GROUP BY 1",
        "sql_join_having": "SELECT i.status, count(*) AS n, count(DISTINCT e.host) AS hosts FROM entries e JOIN imports i ON i.id = e.import_id GROUP BY i.status HAVING count(*) > 5",
        "sql_window": "SELECT import_id, id, CAST(r AS INTEGER) AS r FROM (SELECT import_id, id, row_number() OVER (PARTITION BY import_id ORDER BY id DESC) AS r FROM entries) WHERE r <= 3",
        "sql_sets": "(SELECT request_body_hash AS h FROM entries UNION SELECT response_body_hash FROM entries) EXCEPT SELECT hash FROM blobs",
        "sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
        "sql_subquery": "SELECT o_orderpriority, count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45) GROUP BY o_orderpriority",
        "sql_json": "SELECT id, response_headers::JSON->>'$.server' AS server FROM entries WHERE response_headers::JSON->>'$.server' IS NOT NULL",
    } | more_sql.queries()
