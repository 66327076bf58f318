"""Writers: CSV, JSON Lines, Parquet, and documents rebuilt from rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.masking import form_pairs

#: What tabular exports leave out.
LEFT_OUT = ("id", "graphql_operation_type", "graphql_operation_name", "graphql_top_level_fields")


def tabular(entries: DataFrame) -> DataFrame:
    return entries.drop(*LEFT_OUT)


def write_csv(df: DataFrame, path: str) -> None:
    """NULL and empty text both become an empty field; quotes only where needed."""
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """NULLs are written out."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, by_import: bool = True) -> None:
    (df.write.partitionBy("import_id") if by_import and "import_id" in df.columns else df.write).parquet(path)


def _pairs(json_: Column) -> Column:
    """A JSON object as (name, value) pairs in the order of their names."""
    return F.array_sort(F.transform(F.map_entries(F.coalesce(F.from_json(json_, "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda x: F.struct(x["key"].alias("name"), x["value"].alias("value"))))


def _body(prefix: str) -> list[Column]:
    """Text of a body and its encoding: UTF-8 as it is, anything else in base64."""
    c = F.col(f"{prefix}_content")
    text = F.is_valid_utf8(c.cast("string"))
    some = F.octet_length(c) > 0
    return [F.when(some & text, c.cast("string")).when(some, F.regexp_replace(F.base64(c), r"\s", "")).alias("text"), F.when(some & ~text, "base64").alias("encoding")]


def with_extensions(doc: Column, extensions: Column) -> Column:
    """A JSON object with the members of another after its own."""
    return F.when(F.coalesce(extensions, F.lit("{}")).rlike(r"^\s*\{\s*\}\s*$"), doc).otherwise(F.concat(F.regexp_replace(doc, r"\}$", ""), F.lit(","), F.regexp_replace(extensions, r"^\s*\{", "")))


def capture_entries(entries: DataFrame, blobs: DataFrame | None = None, many_imports: bool = False) -> DataFrame:
    """Entries rebuilt as documents: ``import_id``, ``id``, ``started_at``, ``entry`` (JSON).

    With ``blobs`` bodies are put back, as text where they are UTF-8, and
    ``compression`` is what the stored raw form saved. Where no phase is known,
    all of the time is waiting. With ``many_imports`` page ids get their import's
    number before them. What the store doesn't keep (header sizes, the answer's
    protocol, the cache) is not there or -1.
    """
    e = entries
    for side in ("request", "response"):
        if blobs is None:
            e = e.withColumn(f"{side}_content", F.lit(None).cast("binary"))
        else:
            b = blobs.select(F.col("hash").alias(f"{side}_body_hash"), F.col("content").alias(f"{side}_content"))
            e = e.join(b, f"{side}_body_hash", "left")
    pos = lambda c: F.when(~F.isnan(c) & (F.col(c) >= 0), F.col(c))
    none = F.lit(True)
    for n in ("blocked", "dns", "connect", "send", "wait", "receive", "ssl"):
        none = none & pos(f"{n}_ms").isNull()
    timing = F.struct(*(F.when(none & F.lit(n == "wait"), F.coalesce(pos("time_ms"), F.lit(0.0))).otherwise(F.coalesce(pos(f"{n}_ms"), F.lit(-1.0 if n in ("blocked", "dns", "connect", "ssl") else 0.0))).alias(n) for n in ("blocked", "dns", "connect", "send", "wait", "receive", "ssl")))
    query = form_pairs(F.col("query_string"))
    mime = F.nullif(F.trim(F.split_part(F.get_json_object("request_headers", "$.content-type"), F.lit(";"), F.lit(1))), F.lit(""))
    post = F.when(F.octet_length("request_content") > 0, F.struct(F.coalesce(mime, F.lit("")).alias("mimeType"), *_body("request")))
    cookies = lambda c: F.coalesce(F.from_json(c, "array<map<string,string>>"), F.array().cast("array<map<string,string>>"))
    request = F.to_json(F.struct("method", "url", F.col("http_version").alias("httpVersion"), cookies("request_cookies").alias("cookies"), _pairs(F.col("request_headers")).alias("headers"), F.coalesce(query, F.array().cast("array<struct<name:string,value:string>>")).alias("queryString"), post.alias("postData"), F.lit(-1).alias("headersSize"), F.coalesce("request_body_size", F.lit(-1)).alias("bodySize")))
    saved = F.when(F.col("response_body_size_raw").isNotNull() & (F.col("response_body_size") > F.col("response_body_size_raw")), F.col("response_body_size") - F.col("response_body_size_raw"))
    content = with_extensions(F.to_json(F.struct(F.coalesce("response_body_size", F.lit(0)).alias("size"), saved.alias("compression"), F.coalesce("response_mime_type", F.lit("")).alias("mimeType"), *_body("response"))), F.col("content_extensions"))
    response = F.to_json(F.struct("status", F.coalesce("status_text", F.lit("")).alias("statusText"), F.col("http_version").alias("httpVersion"), cookies("response_cookies").alias("cookies"), _pairs(F.col("response_headers")).alias("headers"), F.parse_json(content).alias("content"), F.coalesce("redirect_url", F.lit("")).alias("redirectURL"), F.lit(-1).alias("headersSize"), F.coalesce("response_body_size_raw", "response_body_size", F.lit(-1)).alias("bodySize")))
    page = F.when(F.col("page_id").isNotNull(), F.concat_ws(":", F.col("import_id").cast("string"), "page_id") if many_imports else F.col("page_id"))
    parts = F.struct(
        page.alias("pageref"), F.col("started_at").alias("startedDateTime"), F.coalesce(F.nanvl("time_ms", F.lit(0.0)), F.lit(0.0)).alias("time"), F.parse_json(with_extensions(request, F.col("request_extensions"))).alias("request"), F.parse_json(with_extensions(response, F.col("response_extensions"))).alias("response"),
        F.parse_json(with_extensions(F.to_json(timing), F.col("timings_extensions"))).alias("timings"), F.col("server_ip").alias("serverIPAddress"), F.col("connection_id").alias("connection"),
    )
    return e.select("import_id", "id", "started_at", with_extensions(F.to_json(parts), F.col("entry_extensions")).alias("entry"))


def capture_pages(pages: DataFrame, many_imports: bool = False) -> DataFrame:
    """Pages rebuilt as documents: ``import_id``, ``id``, ``started_at``, ``page`` (JSON), to be written in the order of start and id."""
    ident = F.concat_ws(":", F.col("import_id").cast("string"), "id") if many_imports else F.col("id")
    timing = with_extensions(F.to_json(F.struct(F.col("on_content_load_ms").alias("onContentLoad"), F.col("on_load_ms").alias("onLoad"))), F.col("page_timings_extensions"))
    doc = F.to_json(F.struct(F.coalesce("started_at", F.lit("")).alias("startedDateTime"), ident.alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.parse_json(timing).alias("pageTimings")))
    return pages.select("import_id", "id", "started_at", with_extensions(doc, F.col("page_extensions")).alias("page"))


def write_capture(entries: DataFrame, pages: DataFrame, path: str, blobs: DataFrame | None = None, pretty: bool = False) -> int:
    """One capture document of all entries in the order of start and id; the number written.

    Rows are sorted by the executors and written as they arrive, so the driver
    holds one partition of them at a time. Imports that are more than one show in the page ids.
    """
    many = entries.select("import_id").distinct().limit(2).count() > 1
    used = pages.join(entries.select("import_id", F.col("page_id").alias("id")).distinct(), ["import_id", "id"], "left_semi")
    space = (lambda t: json.dumps(json.loads(t), indent=2, ensure_ascii=False)) if pretty else (lambda t: t)
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"log":{"version":"1.2","creator":{"name":"tracefold","version":"1"},"pages":[')
        for i, r in enumerate(capture_pages(used, many).orderBy(F.asc_nulls_first("started_at"), "import_id", "id").toLocalIterator()):
            f.write(("," if i else "") + space(r.page))
        f.write('],"entries":[')
        for r in capture_entries(entries, blobs, many).orderBy(F.asc_nulls_first("started_at"), "id").toLocalIterator():
            f.write(("," if n else "") + space(r.entry))
            n += 1
        f.write("]}}\n")
    return n


def trace_events(entries: DataFrame, zones: DataFrame, pages: DataFrame, by: str = "page") -> DataFrame:
    """Events of a browser trace: a metadata event for each group, then a complete event per request, in that order.

    Output ``group_no``, ``turn``, ``event`` (JSON). Times are microseconds from
    the first start, rounded; lengths are never negative.
    """
    from tracefold.operators.report import waterfall

    w = waterfall(entries, zones, pages, by)
    groups = w.groupBy("group_no").agg(F.min("group_name").alias("name"))
    meta = groups.select("group_no", F.lit(0).cast("long").alias("turn"), F.to_json(F.struct(F.lit("thread_name").alias("name"), F.lit("M").alias("ph"), F.lit(1).alias("pid"), F.col("group_no").alias("tid"), F.struct("name").alias("args"))).alias("event"))
    done = w.select("group_no", F.col("row_no").alias("turn"), F.to_json(F.struct(F.concat_ws(" ", "method", "url").alias("name"), F.lit("X").alias("ph"), (F.col("start_us") - F.col("first_us")).alias("ts"), F.round(F.col("duration_ms") * 1000).cast("long").alias("dur"), F.lit(1).alias("pid"), F.col("group_no").alias("tid"), F.struct("status", "id").alias("args"))).alias("event"))
    return meta.unionByName(done)
