"""Entries as spans of a trace, with their phases, attributes and the document that collectors take."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.operators.analysis import header
from tracefold.operators.filters import stable_sample
from tracefold.operators.hosts import measured
from tracefold.operators.timestamps import readable_starts
from tracefold.operators.views import host_of, phase_layout, url_parts


def seed() -> Column:
    """What an entry's ids are made of, so that they are the same every time."""
    return F.concat_ws("|", F.coalesce("entry_hash", F.lit("")), F.coalesce("url", F.lit("")), F.coalesce("started_at", F.lit("")), F.col("id").cast("string"))


def _span_id(kind: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.col("seed"), F.lit("|"), kind), 256), 1, 16)


def spans(entries: DataFrame) -> DataFrame:
    """One client span per entry; its duration is the measured time, else the end of its last phase."""
    last = phase_layout(entries).groupBy("id").agg(F.max("end_ms").alias("last_ms"))
    e = entries.withColumn("seed", seed()).join(last, "id", "left")
    return e.select(
        "id", F.substring(F.sha2("seed", 256), 1, 32).alias("trace_id"), _span_id(F.lit("request")).alias("span_id"), F.concat_ws(" ", F.upper("method"), F.coalesce("path", F.lit("/"))).alias("name"),
        F.when(F.col("status") >= 400, "Error").when(F.col("status").isNotNull(), "Ok").otherwise("Unset").alias("status_code"), F.coalesce(measured(F.col("time_ms")), F.col("last_ms"), F.lit(0.0)).alias("duration_ms"),
    )


def phase_spans(entries: DataFrame) -> DataFrame:
    """A child span for each phase of an entry that takes any time, placed from the entry's start."""
    p = phase_layout(entries).where("end_ms > start_ms").join(entries.select("id", seed().alias("seed")), "id")
    return p.select("id", F.substring(F.sha2("seed", 256), 1, 32).alias("trace_id"), _span_id(F.lit("request")).alias("parent_span_id"), _span_id(F.col("phase")).alias("span_id"), F.col("phase").alias("name"), "start_ms", F.round(F.col("end_ms") - F.col("start_ms"), 6).alias("duration_ms"))


def cache_state() -> dict[str, Column]:
    """What a cache said about an answer: its header, whether it was a hit, and the answer's age."""
    said = F.coalesce(*(header(F.col("response_headers"), h) for h in ("x-cache", "x-cache-status", "cf-cache-status")))
    return {"cache.status": said, "cache.hit": F.lower(said).contains("hit"), "cache.age": F.trim(header(F.col("response_headers"), "age")).try_cast("long")}


def attributes(entries: DataFrame) -> DataFrame:
    """Attributes of each span that are known: ``id``, ``key``, ``value`` (text) and ``kind`` (string, int or bool)."""
    u = url_parts(F.col("url"))
    c = cache_state()
    known = [
        ("http.request.method", F.upper("method"), "string"), ("url.full", F.col("url"), "string"), ("url.path", F.col("path"), "string"), ("url.query", F.col("query_string"), "string"), ("url.scheme", u["scheme"], "string"), ("server.address", host_of(), "string"),
        ("server.port", u["port"].cast("int"), "int"), ("http.response.status_code", F.col("status"), "int"), ("http.request.body.size", F.when(F.col("request_body_size") >= 0, F.col("request_body_size")), "int"),
        ("http.response.body.size", F.when(F.col("response_body_size") >= 0, F.col("response_body_size")), "int"), ("http.response.mime_type", F.col("response_mime_type"), "string"), ("network.peer.address", F.col("server_ip"), "string"),
        ("network.protocol.name", F.lower("http_version"), "string"), ("http.connection_id", F.col("connection_id"), "string"), ("tls.protocol.version", F.col("tls_version"), "string"), ("tls.cipher", F.col("tls_cipher_suite"), "string"), ("page.id", F.col("page_id"), "string"),
        ("graphql.operation.type", F.col("graphql_operation_type"), "string"), ("graphql.operation.name", F.col("graphql_operation_name"), "string"), ("cache.status", c["cache.status"], "string"), ("cache.hit", c["cache.hit"], "bool"), ("cache.age", c["cache.age"], "int"),
    ]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"), F.lit(t).alias("kind")) for k, v, t in known)))
    return entries.select("id", rows.alias("x")).select("id", "x.*").where("value is not null")


def resource(pairs: list[str], service: str = "tracefold") -> dict[str, str]:
    """``key=value`` texts as a dict; a key or sign that is missing is an error, and a service name is always there."""
    out = {}
    for p in pairs:
        k, sign, v = p.partition("=")
        if not sign or not k.strip():
            raise ValueError(f"not a key=value pair: {p!r}")
        out[k.strip()] = v.strip()
    return {"service.name": service} | out


def documents(entries: DataFrame, zones: DataFrame, rate: float = 1.0, phases: bool = True, most: int | None = None) -> DataFrame:
    """Spans as the JSON that collectors take, one row per entry with a readable start, in the order of start and id.

    ``rate`` keeps a stable share of the entries; ``most`` is the number of spans after which a report ends.
    """
    rows = readable_starts(stable_sample(entries, ["entry_hash", "url", "started_at"], rate), zones)
    if most is not None:
        rows = rows.orderBy("start_us", "id").limit(most)
    attr = attributes(rows).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("key", F.struct(
        F.when(F.col("kind") == "string", F.col("value")).alias("stringValue"), F.when(F.col("kind") == "int", F.col("value").cast("long")).alias("intValue"), F.when(F.col("kind") == "bool", F.col("value").cast("boolean")).alias("boolValue")
    ).alias("value")))).alias("attributes"))
    ns = lambda ms: (F.col("start_us") * 1000 + F.round(ms * 1000000).cast("long"))
    s = spans(rows).join(rows.select("id", "start_us"), "id").join(attr, "id", "left")
    code = F.when(F.col("status_code") == "Ok", 1).when(F.col("status_code") == "Error", 2).otherwise(0)
    out = s.select("id", "start_us", F.lit(0).alias("turn"), F.to_json(F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), "name", F.lit(3).alias("kind"), ns(F.lit(0.0)).alias("startTimeUnixNano"), ns(F.col("duration_ms")).alias("endTimeUnixNano"), "attributes", F.struct(code.alias("code")).alias("status"))).alias("span"))
    if phases:
        p = phase_spans(rows).join(rows.select("id", "start_us"), "id")
        out = out.unionByName(p.select("id", "start_us", F.lit(1).alias("turn"), F.to_json(F.struct(F.col("trace_id").alias("traceId"), F.col("span_id").alias("spanId"), F.col("parent_span_id").alias("parentSpanId"), "name", F.lit(1).alias("kind"), ns(F.col("start_ms")).alias("startTimeUnixNano"), ns(F.col("start_ms") + F.col("duration_ms")).alias("endTimeUnixNano"))).alias("span")))
    return out


def request_body(spans_json: list[str], about: dict[str, str]) -> str:
    """A collector's request around spans that are JSON already."""
    attrs = [{"key": k, "value": {"stringValue": v}} for k, v in sorted(about.items())]
    return '{"resourceSpans":[{"resource":' + json.dumps({"attributes": attrs}) + ',"scopeSpans":[{"scope":{"name":"tracefold"},"spans":[' + ",".join(spans_json) + "]}]}]}"


def send(docs: DataFrame, endpoint: str, about: dict[str, str], batch: int = 512, timeout: float = 10.0) -> int:
    """Posts spans as JSON to a collector from the executors, ``batch`` at a time; the number sent.

    An answer other than 2xx is an error. A task that is run again sends its
    spans again; their ids are the same, so a collector can tell.
    """
    import pyarrow as pa

    def run(batches):
        sent = 0
        for b in batches:
            part = b.column(0).to_pylist()
            for i in range(0, len(part), batch):
                data = request_body(part[i : i + batch], about).encode()
                with urllib.request.urlopen(urllib.request.Request(endpoint, data, {"Content-Type": "application/json"}), timeout=timeout) as r:
                    if r.status // 100 != 2:
                        raise OSError(f"collector answered {r.status}")
                sent += len(part[i : i + batch])
        yield pa.RecordBatch.from_pydict({"n": pa.array([sent], pa.int64())})

    return docs.select("span").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
