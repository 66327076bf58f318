"""Capture files (HTTP Archive) as rows of the store's tables."""

from __future__ import annotations

import codecs
import gzip
import io
import json
import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from typing import IO

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.functions import bodies
from tracefold.operators.store import entry_hash
from tracefold.operators.views import url_parts
from tracefold.plans.scan import running_sum
from tracefold.plans.shared import Spool

HEADER = "array<struct<name:string,value:string>>"
#: Keys with a column of their own; any other key of the object is kept as an extension.
_KNOWN = {
    "entry": ["pageref", "startedDateTime", "time", "serverIPAddress", "serverIpAddress", "connection", "cache", "request", "response", "timings"],
    "request": ["method", "url", "httpVersion", "headers", "cookies", "queryString", "postData", "headersSize", "bodySize"],
    "response": ["status", "statusText", "httpVersion", "headers", "cookies", "content", "redirectURL", "redirectUrl", "headersSize", "bodySize"],
    "content": ["size", "compression", "mimeType", "text", "encoding"],
    "page": ["startedDateTime", "id", "title", "pageTimings"], "page_timings": ["onContentLoad", "onLoad"], "log": ["version", "creator", "browser", "pages", "entries"],
    "post": ["mimeType", "text", "params"],
    "timings": ["blocked", "dns", "connect", "send", "wait", "receive", "ssl"],
}


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _extensions(v: Column, level: str) -> Column:
    known = F.array(*map(F.lit, _KNOWN[level]))
    m = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~F.array_contains(known, k))
    return F.when(F.size(m) > 0, F.to_json(m))


def header_object(headers: Column) -> Column:
    """An array of headers as a JSON object, names in lower case, the last of equal names winning."""
    names = F.transform(headers, lambda h: F.lower(h["name"]))
    last = F.filter(F.transform(headers, lambda h, i: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value"), i.alias("i"))), lambda h: ~F.array_contains(F.slice(names, h["i"] + 2, F.size(names)), h["name"]))
    return F.to_json(F.map_from_entries(F.transform(last, lambda h: F.struct(h["name"], h["value"]))))


def header_value(headers: Column, name: str) -> Column:
    """The first header of a name, without blanks at the ends; NULL if empty."""
    hit = F.filter(headers, lambda h: F.lower(h["name"]) == name)
    return F.nullif(F.trim(F.try_element_at(hit, F.lit(1))["value"]), F.lit(""))


_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]|[^\s"{}\[\],:]+', re.S)


def scan_capture(stream: IO[bytes], name: str = "", chunk: int = 1 << 20) -> Iterator[tuple[int, str]]:
    """The entries of a capture document one by one as (position, JSON), and in the end (-1, the document without them).

    The stream is read in parts; no more than one entry and the rest of the
    document is held, however large the file. A document without ``log`` or
    ``entries``, with a key of ``log`` twice, with text after its end or cut off
    raises ValueError.
    """
    decode = codecs.getincrementaldecoder("utf-8-sig")("replace").decode
    buf, at, ended = "", 0, False
    rest: list[str] = []
    stack: list[list] = []  # per open container: its bracket, its last key, is a key expected
    start = -1  # where in buf the entry being read begins
    position = 0
    done = False

    def inside() -> bool:
        return len(stack) == 3 and stack[2][0] == "[" and stack[0][1] == '"log"' and stack[1][1] == '"entries"' and stack[1][0] == "{"

    while True:
        m = _TOKEN.search(buf, at)
        gap = buf[at : m.start()] if m else buf[at:]
        whole = m is not None and not gap.strip() and (m.end() < len(buf) or ended or m[0] in "{}[],:")
        if not whole:
            if ended:
                if gap.strip() or stack:
                    raise ValueError(f"not a capture document: {name}: it ends too early")
                break
            keep = at if start < 0 else start
            buf, at, start = buf[keep:], at - keep, 0 if start >= 0 else -1
            data = stream.read(max(chunk, len(buf)))
            ended = not data
            buf += decode(data, final=ended)
            continue
        t = m[0]
        if done:
            raise ValueError(f"not a capture document: {name}: text after its end")
        if inside() and start < 0 and t not in ",]":
            start = m.start()
        element = inside() if t in ",]" else False
        if t in "}]":
            if not stack or {"}": "{", "]": "["}[t] != stack[-1][0]:
                raise ValueError(f"not a capture document: {name}: brackets don't match")
            if element and start >= 0:
                yield position, buf[start : m.start()]
                position, start = position + 1, -1
            stack.pop()
            done = not stack
        elif element:  # a comma between entries
            if start < 0:
                raise ValueError(f"not a capture document: {name}: an entry is missing")
            yield position, buf[start : m.start()]
            position, start = position + 1, -1
            at = m.end()
            continue
        elif stack and stack[-1][0] == "{":
            if t == ",":
                stack[-1][2] = True
            elif t == ":":
                stack[-1][2] = False
            elif t[0] == '"' and stack[-1][2]:
                stack[-1][1] = t
        if start < 0:
            rest.append(t)
        if t in "{[":
            stack.append([t, None, t == "{"])
        at = m.end()

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs) and any(k == "entries" for k, _ in pairs):
            raise ValueError(f"not a capture document: {name}: a key of log stands twice")
        return dict(pairs)

    text = "".join(rest)
    doc = json.loads(text, object_pairs_hook=once) if text else None
    if not isinstance(doc, dict) or not isinstance(doc.get("log"), dict) or not isinstance(doc["log"].get("entries"), list):
        raise ValueError(f"not a capture document: {name}: no log with entries")
    yield -1, text


def _open(path: str) -> IO[bytes]:
    """The bytes of a file, decompressed if its name or its first two bytes say so."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path.replace("file:///", "file:/").replace("file:/", "file:///"))
        raw = system.open_input_stream(inner, compression=None)
    else:
        raw = open(path, "rb")
    if path.lower().endswith(".br"):
        raise ValueError("brotli needs a codec that this build doesn't have")
    head = raw.read(2)
    whole = _Joined(head, raw)
    return gzip.GzipFile(fileobj=whole) if head == b"\x1f\x8b" or path.lower().endswith(".gz") else whole


class _Joined(io.RawIOBase):
    """A stream with the bytes already read put back before it."""

    def __init__(self, head: bytes, rest):
        self.head, self.rest = head, rest

    def readable(self) -> bool:
        return True

    def read(self, n: int = -1) -> bytes:
        if self.head:
            out, self.head = self.head, b""
            return out + (self.rest.read() if n < 0 else b"")
        return self.rest.read() if n < 0 else self.rest.read(n)


def read_captures(spark: SparkSession, paths: list[str], ahead: bool = True) -> DataFrame:
    """``source_file``, ``position`` and ``doc``: one row per entry, and one per file at position -1 with all else.

    Files are read entry by entry, each by one task, whatever their size; gzip is
    known by name or first bytes, brotli is refused. ``ahead`` (reading in the
    background) is accepted and means nothing here, as tasks overlap anyway. The
    rows are written once to the shared folder, so that nothing is read twice.
    """
    for p in paths:
        if p.lower().endswith(".br"):
            raise ValueError("brotli needs a codec that this build doesn't have")
    files = spark.createDataFrame([(p,) for p in paths], "source_file string").repartition(max(1, len(paths)))

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                rows: list[tuple[int, str]] = []
                size = 0
                for row in scan_capture(_open(p), p):
                    rows.append(row)
                    size += len(row[1])
                    if size > 1 << 22:
                        yield _rows(p, rows)
                        rows, size = [], 0
                yield _rows(p, rows)

    def _rows(p, rows):
        return pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["source_file", "position", "doc"])

    return Spool(spark).put("captures", files.mapInArrow(run, "source_file string, position long, doc string"))


#: Paths that an entry must have.
_REQUIRED = ["startedDateTime", "time", "request.method", "request.url", "request.httpVersion", "request.headers", "response.status", "response.statusText", "response.headers", "response.content.size"]
# Keys under which captures tell about the connection's security and what started a request.
_TLS_KEYS = {
    "tls_version": ["protocol", "tlsVersion", "version"], "tls_cipher_suite": ["cipher", "cipherSuite", "cipherSuiteName"], "tls_cert_subject": ["subjectName", "subject", "certificateSubject", "certSubject"],
    "tls_cert_issuer": ["issuer", "issuerName", "certificateIssuer", "certIssuer"], "tls_cert_expiry": ["validTo", "expiry", "expires", "notAfter", "expiresAt"],
}
_TLS_INSIDE = ["certificate", "cert", "certificates"]
_TLS_AT = ["securityDetails", "_securityDetails", "security", "_security", "tls", "_tls", "tlsDetails"]
_STARTER = {"parent_request_id": ["requestId", "request_id", "parentRequestId", "parent_request_id"], "initiator_url": ["url", "initiatorUrl", "sourceURL"], "initiator_line": ["lineNumber", "line"], "initiator_column": ["columnNumber", "column"]}


def _expiry(v) -> str | None:
    """A certificate's end as RFC 3339: from such a text, a date, or seconds or (from 10**12 on) milliseconds since 1970."""
    try:
        if isinstance(v, str):
            v = v.strip()
            if v.isdigit():
                v = int(v)
            else:
                t = datetime.fromisoformat(v.replace("Z", "+00:00"))
                if not t.tzinfo and len(v) > 10:
                    return None
                return (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat()
        if isinstance(v, int) and not isinstance(v, bool):
            return datetime.fromtimestamp(v / 1000 if abs(v) >= 10**12 else v, timezone.utc).isoformat()
    except (ValueError, OverflowError, OSError):
        pass
    return None


def security_of(levels: list[dict]) -> dict[str, str | None]:
    """What the extensions of an entry, its response, request and content (in that order) tell about TLS, the first to tell counts.

    At each level its own keys come before those of nested objects; certificates
    may be objects or lists of them.
    """
    out: dict[str, str | None] = dict.fromkeys(_TLS_KEYS)

    def told(m: dict) -> dict[str, str | None]:
        got: dict[str, str | None] = {}
        for field, keys in _TLS_KEYS.items():
            if field == "tls_cert_expiry":
                got[field] = next((_expiry(m[k]) for k in keys if k in m), None)
            else:
                got[field] = next((m[k].strip() for k in keys if isinstance(m.get(k), str) and m[k].strip()), None)
        if not (got["tls_cert_subject"] and got["tls_cert_issuer"] and got["tls_cert_expiry"]):
            fill(got, next((m[k] for k in _TLS_INSIDE if k in m), None))
        return got

    def fill(into: dict, v) -> None:
        todo = [v]
        while todo:
            v = todo.pop(0)
            if isinstance(v, list):
                todo = v + todo
            elif isinstance(v, dict) and any((got := told(v)).values()):
                into.update({k: into.get(k) or x for k, x in got.items()})
                return

    for m in levels:
        here = told(m)
        for k in _TLS_AT:
            fill(here, m.get(k))
        out = {k: out[k] or here[k] for k in out}
    return out


def starter_of(levels: list[dict]) -> dict:
    """What started a request, by its own keys, else by the first frame with a URL in its stack or the stacks that led there."""
    v = next((m[k] for m in levels for k in ("_initiator", "initiator") if m.get(k) is not None), None)
    if not isinstance(v, dict):
        return {}
    text = lambda m, keys: next((str(m[k]) for k in keys if isinstance(m.get(k), (str, int)) and not isinstance(m.get(k), bool) and str(m[k]).strip()), None)
    whole = lambda m, keys: next((int(m[k]) for k in keys if isinstance(m.get(k), (int, float)) and not isinstance(m.get(k), bool)), None)
    take = lambda m: {k: (whole if k in ("initiator_line", "initiator_column") else text)(m, keys) for k, keys in _STARTER.items()}
    out = {"initiator_type": text(v, ["type"]), **take(v)}
    stack = v.get("stack")
    while isinstance(stack, dict):
        frame = next((f for f in stack.get("callFrames") or [] if isinstance(f, dict) and text(f, ["url"])), None)
        if frame:
            found = take(frame)
            out |= {k: found[k] for k in ("initiator_url", "initiator_line", "initiator_column") if out[k] is None}
            break
        stack = stack.get("parent")
    return out


_TOLD = T.StructType([*(T.StructField(k, T.StringType()) for k in (*_TLS_KEYS, "initiator_type", "parent_request_id", "initiator_url")), T.StructField("initiator_line", T.LongType()), T.StructField("initiator_column", T.LongType())])


@F.pandas_udf(_TOLD)
def _told(entry: pd.Series, request: pd.Series, response: pd.Series, content: pd.Series) -> pd.DataFrame:
    known: dict[tuple, dict] = {}

    def one(*texts) -> dict:
        if texts not in known:
            e, q, r, c = (json.loads(t) if t else {} for t in texts)
            known[texts] = security_of([e, r, q, c]) | starter_of([e, q, r])
        return known[texts]

    rows = [one(*x) for x in zip(entry, request, response, content)]
    out = pd.DataFrame(rows, columns=_TOLD.names, dtype=object)
    return out.astype(object)


def entries_of(captures: DataFrame, strict: bool = True, max_body: int | None = None, text_only: bool = False, decompress: bool = False, keep_raw: bool = False) -> DataFrame:
    """Entries with the store's columns, in file order (``position``), and the bodies to be stored.

    Columns beyond the store's: ``body``, ``raw_body`` and ``posted``. With
    ``strict`` an entry without a required field is an error. Bodies above
    ``max_body`` bytes (after decompression, if asked for) and, with
    ``text_only``, those of other types are left out.
    """
    e = captures.where("position >= 0").select("source_file", "position", F.parse_json("doc").alias("e"))
    if strict:
        lacks = F.coalesce(*(F.when(F.try_variant_get("e", f"$.{p}", "variant").isNull(), F.lit(p)) for p in _REQUIRED))
        e = e.withColumn("lacks", lacks)
        e = e.withColumn("source_file", F.when(F.col("lacks").isNull(), F.col("source_file")).otherwise(F.raise_error(F.concat(F.lit("not a capture document: "), F.col("lacks"), F.lit(" is missing in "), F.col("source_file")))))
    e = e.select("*", *(F.try_variant_get("e", f"$.{n}", "variant").alias(n) for n in ("request", "response", "timings")), F.try_variant_get("e", "$.response.content", "variant").alias("content"))
    e = e.withColumns({"rh": _get(F.col("request"), "$.headers", HEADER), "sh": _get(F.col("response"), "$.headers", HEADER), "url": _get(F.col("request"), "$.url"), "status": _get(F.col("response"), "$.status", "int")})
    u = url_parts(F.col("url"))
    ms = {f"{n}_ms": (lambda c: F.when(c >= 0, c))(_get(F.col("timings"), f"$.{n}", "double")) for n in _KNOWN["timings"]}
    size = lambda v, p: (lambda c: F.when(c >= 0, c))(_get(F.col(v), p, "long"))
    mime = F.coalesce(_get(F.col("content"), "$.mimeType"), F.trim(F.split_part(header_value(F.col("sh"), "content-type"), F.lit(";"), F.lit(1))))
    raw = bodies.decoded(_get(F.col("content"), "$.text"), _get(F.col("content"), "$.encoding"))
    coding = header_value(F.col("sh"), "content-encoding")
    plain = bodies.unpacked(raw, coding, max_body or bodies.MAX_DECOMPRESSED) if decompress else raw
    # a body that can't be unpacked is kept as it came
    plain = F.coalesce(plain, raw)
    post = F.try_variant_get(F.col("request"), "$.postData", "variant")
    post_mime = F.coalesce(_get(post, "$.mimeType"), header_value(F.col("rh"), "content-type"))
    posted = F.encode(bodies.form_of(_get(post, "$.params", "array<struct<name:string,value:string>>"), _get(post, "$.text"), post_mime), "UTF-8")
    e = e.withColumns({"mime": mime, "raw": raw, "plain": plain, "posted": posted, "post_mime": post_mime, "post": post})
    e = e.withColumns({"body": F.when(bodies.kept(F.col("plain"), F.col("mime"), True, text_only, max_body), F.col("plain")), "posted": F.when(bodies.kept(F.col("posted"), F.col("post_mime"), True, text_only, max_body), F.col("posted"))})
    e = e.withColumn("raw_body", F.when(F.lit(keep_raw) & F.col("body").isNotNull() & (F.col("raw") != F.col("plain")), F.col("raw")))
    body, hashed = F.col("body"), lambda c: F.when(F.octet_length(c) > 0, F.sha2(c, 256))
    told = _told(_extensions(F.col("e"), "entry"), _extensions(F.col("request"), "request"), _extensions(F.col("response"), "response"), _extensions(F.col("content"), "content"))
    e = e.withColumn("told", F.when(F.to_json("e").rlike("(?i)security|tls|cert|initiator|cipher|protocol"), told))
    redirect = F.coalesce(F.nullif(F.trim(F.coalesce(_get(F.col("response"), "$.redirectURL"), _get(F.col("response"), "$.redirectUrl"))), F.lit("")), header_value(F.col("sh"), "location"))
    ids = [_get(F.col(v), f"$.{k}") for v in ("e", "request", "response") for k in ("_requestId", "requestId", "request_id")]
    return e.select(
        "source_file", "position", _get(F.col("e"), "$.pageref").alias("page_id"), _get(F.col("e"), "$.startedDateTime").alias("started_at"), _get(F.col("e"), "$.time", "double").alias("time_ms"), *(c.alias(k) for k, c in ms.items()),
        _get(F.col("request"), "$.method").alias("method"), "url", u["host"].alias("host"), u["path"].alias("path"), u["query"].alias("query_string"), _get(F.col("request"), "$.httpVersion").alias("http_version"),
        header_object(F.col("rh")).alias("request_headers"), F.coalesce(F.to_json(_get(F.col("request"), "$.cookies", "array<variant>")), F.lit("[]")).alias("request_cookies"), F.coalesce(F.octet_length("posted").cast("long"), size("request", "$.bodySize")).alias("request_body_size"),
        "status", _get(F.col("response"), "$.statusText").alias("status_text"), header_object(F.col("sh")).alias("response_headers"), F.coalesce(F.to_json(_get(F.col("response"), "$.cookies", "array<variant>")), F.lit("[]")).alias("response_cookies"),
        hashed(body).alias("response_body_hash"), F.coalesce(F.octet_length(body).cast("long"), size("content", "$.size")).alias("response_body_size"), "body", "raw_body", "posted", "post_mime",
        hashed(F.col("posted")).alias("request_body_hash"), hashed(F.col("raw_body")).alias("response_body_hash_raw"), F.octet_length("raw_body").cast("long").alias("response_body_size_raw"), F.col("mime").alias("response_mime_type"), _extensions(F.col("post"), "post").alias("post_data_extensions"),
        *(F.col(f"told.{k}").alias(k) for k in _TOLD.names), F.col("status").between(300, 399).cast("int").alias("is_redirect"),
        F.coalesce(_get(F.col("e"), "$.serverIPAddress"), _get(F.col("e"), "$.serverIpAddress")).alias("server_ip"), _get(F.col("e"), "$.connection").alias("connection_id"), F.coalesce(*ids).alias("request_id"),
        F.when(F.col("status").between(300, 399), redirect).alias("redirect_url"), _extensions(F.col("e"), "entry").alias("entry_extensions"), _extensions(F.col("request"), "request").alias("request_extensions"),
        _extensions(F.col("response"), "response").alias("response_extensions"), _extensions(F.col("content"), "content").alias("content_extensions"), _extensions(F.col("timings"), "timings").alias("timings_extensions"),
    )


def with_hash(entries: DataFrame) -> DataFrame:
    """Entries with ``entry_hash``; NULL and '' differ."""
    return entries.withColumn("entry_hash", entry_hash())


def redirect_parents(entries: DataFrame) -> DataFrame:
    """``parent_request_id`` for requests that a redirect of the same file led to and nothing else is known to have started.

    Redirects register their target, later requests of that URL use it up: the
    parent is the registration directly before among the events of that URL, and
    none if another request took it first. The event before is carried along
    range-sorted rows, so a URL with very many requests is spread over partitions.
    """
    from tracefold.operators.hierarchy import _resolved
    from tracefold.plans.scan import previous

    known = entries if "parent_request_id" in entries.columns else entries.withColumn("parent_request_id", F.lit(None).cast("string"))
    use = known.where("parent_request_id is null").select("source_file", F.col("url").alias("key"), "position", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("rid"))
    able = known.where(F.col("request_id").isNotNull() & F.col("redirect_url").isNotNull())
    keys = F.explode(F.array_distinct(F.array("redirect_url", F.coalesce(_resolved("redirect_url", "url"), F.col("redirect_url")))))
    give = able.select("source_file", keys.alias("key"), "position", F.lit(1).alias("kind"), F.col("request_id").alias("rid"))
    events = Spool(entries.sparkSession).put("events", use.unionByName(give))
    found = previous(events, ["source_file", "key"], ["position", "kind"], "rid", "via").where((F.col("kind") == 0) & F.col("via").isNotNull())
    j = known.join(found.select("source_file", "position", "via"), ["source_file", "position"], "left")
    return j.withColumn("parent_request_id", F.coalesce("parent_request_id", "via")).drop("via")


def pages_of(captures: DataFrame) -> DataFrame:
    p = captures.where("position = -1").select("source_file", F.explode(F.try_variant_get(F.parse_json("doc"), "$.log.pages", "array<variant>")).alias("p"))
    timing = F.try_variant_get("p", "$.pageTimings", "variant")
    return p.select(
        "source_file", _get(F.col("p"), "$.id").alias("id"), _get(F.col("p"), "$.startedDateTime").alias("started_at"), _get(F.col("p"), "$.title").alias("title"),
        _get(timing, "$.onContentLoad", "double").alias("on_content_load_ms"), _get(timing, "$.onLoad", "double").alias("on_load_ms"), _extensions(F.col("p"), "page").alias("page_extensions"), _extensions(timing, "page_timings").alias("page_timings_extensions"),
    )


def blobs_of(entries: DataFrame) -> DataFrame:
    """Each body once, of responses, their raw variants and requests."""
    part = lambda h, c, m: F.struct(F.col(h).alias("hash"), F.col(c).alias("content"), F.col(m).alias("mime_type"))
    rows = entries.select(F.explode(F.array(part("response_body_hash", "body", "response_mime_type"), part("response_body_hash_raw", "raw_body", "response_mime_type"), part("request_body_hash", "posted", "post_mime"))).alias("b")).select("b.*").where("hash is not null")
    return rows.groupBy("hash").agg(F.first("content").alias("content"), F.max(F.octet_length("content")).cast("long").alias("size"), F.min("mime_type").alias("mime_type")).withColumn("external_path", F.lit(None).cast("string"))


def load(spark: SparkSession, paths: list[str], path: str, incremental: bool = False, resume: bool = False, filters: dict | None = None, keep: list | None = None, change: list | None = None, graphql: bool = True, now: str | None = None, **bodies_kept) -> DataFrame:
    """Loads captures into the store at ``path``; returns its new rows of ``imports``.

    Ids go on from the largest there. ``incremental`` leaves out entries whose
    hash the store or the load already has; ``resume`` goes on with the newest
    unfinished import of a file instead of beginning another. ``filters`` are
    those of ``filters.on_import``; ``keep`` and ``change`` are plugins that allow
    and change entries. Pages are added once per (id, import), bodies
    once per hash, and an import counts once its own row is written, last of all.
    """
    from tracefold import plugins
    from tracefold.functions.graphql import field_rows, operations
    from tracefold.functions.instants import with_instant
    from tracefold.operators.filters import on_import
    from tracefold.operators.store import Store, columns, resume_points

    store, spool = Store(spark, path), Spool(spark)
    now = now or datetime.now(timezone.utc).isoformat()
    captures = read_captures(spark, [os.path.realpath(p) if "://" not in p else p for p in paths])
    old = store.table("imports")
    top_import, top_entry = (store.table(t).agg(F.max("id")).first()[0] or 0 for t in ("imports", "entries"))
    names = sorted(r.source_file for r in captures.select("source_file").distinct().collect())  # one row per file of this load
    numbers = {n: top_import + 1 + i for i, n in enumerate(names)}
    if resume:
        numbers |= {r.source_file: r.import_id for r in resume_points(old.where(F.col("source_file").isin(names)), store.table("entries")).collect()}
    ids = F.broadcast(spark.createDataFrame(list(numbers.items()), "source_file string, import_id long"))  # one row per file of this load
    e = entries_of(captures, **bodies_kept)
    total = e.groupBy("source_file").agg(F.count(F.lit(1)).alias("entries_total"))
    if filters:
        e = on_import(with_instant(e, F.col("started_at"), F.lit("UTC"), "start_us"), **filters).drop("start_us")
    e = with_hash(spool.put("parsed", plugins.run(e, keep, change)))
    if incremental or resume:
        e = e.join(store.table("entries").select("entry_hash").where("entry_hash is not null").distinct(), "entry_hash", "left_anti")
        e = e.groupBy("entry_hash").agg(F.min_by(F.struct(*[c for c in e.columns if c != "entry_hash"]), F.struct("source_file", "position")).alias("r")).select("entry_hash", "r.*")
    # what was left out above leads nowhere
    e = spool.put("kept", redirect_parents(spool.put("left", e)).join(ids, "source_file"))
    e = running_sum(e.withColumn("__one", F.lit(1).cast("long")), [], ["source_file", "position"], "__one", "__no").withColumn("id", F.col("__no") + 1 + top_entry).drop("__one", "__no")
    e = spool.put("numbered", e)
    fields = spark.createDataFrame([], "entry_id long, field string")
    if graphql:
        g = spool.put("graphql", operations(e.select("id", "url", "post_mime", F.col("posted").cast("string").alias("text")), "id", "url", "post_mime", "text"))
        e = e.join(g, "id", "left").withColumns({"graphql_operation_type": F.col("type"), "graphql_operation_name": F.col("name"), "graphql_top_level_fields": F.to_json("fields")})
        fields = field_rows(g, "id")
    kept = e.groupBy("import_id").agg(F.count(F.lit(1)).alias("entry_count"))
    heads = captures.where("position = -1").select("source_file", _extensions(F.try_variant_get(F.parse_json("doc"), "$.log", "variant"), "log").alias("log_extensions"))
    rows = ids.join(heads, "source_file").join(total, "source_file", "left").join(kept, "import_id", "left")
    rows = rows.select(F.col("import_id").alias("id"), "source_file", F.lit(now).alias("imported_at"), F.coalesce("entry_count", F.lit(0)).alias("entry_count"), "log_extensions", F.lit("complete").alias("status"), F.coalesce("entries_total", F.lit(0)).alias("entries_total"))
    rows = spool.put("imports", rows.withColumn("entries_skipped", F.col("entries_total") - F.col("entry_count")))
    store.add(rows, pages_of(captures).join(ids, "source_file"), e.select(*(c for c in columns("entries") if c in e.columns)), blobs_of(e), fields)
    if resume:
        from tracefold.operators.store import recount

        store.replace("imports", spool.put("all_imports", recount(store.table("imports").groupBy("id").agg(*(F.max_by(c, "imported_at").alias(c) for c in columns("imports") if c != "id")), store.table("entries"))))
    return rows

