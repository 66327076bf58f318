"""Sending recorded requests again and comparing the answers; answering requests from recordings."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracefold.operators.filters import for_replay

#: Headers that belong to one connection and are neither sent again nor answered with.
HOP_BY_HOP = {"connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade", "host", "content-length"}
SCHEMA = "id long, method string, url string, recorded_status int, status int, recorded_size long, size long, recorded_ms double, ms double, header_changes int, changed boolean, error string"


def host_rules(texts: list[str]) -> list[tuple[re.Pattern, str]]:
    """``<pattern>=<host[:port]>``: URLs that match are sent there instead."""
    out = []
    for t in texts:
        pattern, sign, host = t.rpartition("=")
        if not sign or not pattern or not re.fullmatch(r"[^\s/=]+", host):
            raise ValueError(f"not a pattern=host rule: {t!r}")
        out.append((re.compile(pattern), host))
    return out


def header_rules(texts: list[str]) -> list[tuple[re.Pattern | None, str, str]]:
    """``[<pattern>:]<name>=<value>``: requests (that match) get the header."""
    out = []
    for t in texts:
        left, sign, value = t.partition("=")
        pattern, colon, name = left.rpartition(":")
        if not sign or not name.strip():
            raise ValueError(f"not a name=value rule: {t!r}")
        out.append((re.compile(pattern) if colon else None, name.strip(), value.strip()))
    return out


def redirected(url: str, rules: list[tuple[re.Pattern, str]]) -> str:
    """The URL with the host of the first rule that matches."""
    for pattern, host in rules:
        if pattern.search(url):
            return urlunsplit(urlsplit(url)._replace(netloc=host))
    return url


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def _ask(opener, row, hosts, headers, timeout: float) -> dict:
    out = {"id": row.id, "method": row.method, "url": row.url, "recorded_status": row.status, "status": None, "recorded_size": row.size, "size": None, "recorded_ms": row.ms, "ms": None, "header_changes": None, "changed": True, "error": None}
    sent = {k: v for k, v in json.loads(row.request_headers or "{}").items() if k.lower() not in HOP_BY_HOP}
    for pattern, name, value in headers:
        if pattern is None or pattern.search(row.url):
            sent[name] = value
    began = time.time()
    try:
        body = bytes(row.body) if row.body is not None else None
        with opener.open(urllib.request.Request(redirected(row.url, hosts), data=body, headers=sent, method=row.method.upper()), timeout=timeout) as r:
            status, data, got = r.status, r.read(), r.headers
    except urllib.error.HTTPError as e:
        status, data, got = e.code, e.read(), e.headers
    except (OSError, ValueError) as e:
        return out | {"error": str(e)[:200]}
    old = {k.lower(): v for k, v in json.loads(row.response_headers or "{}").items()}
    new = {k.lower(): v for k, v in got.items()}
    differ = sum(old.get(k) != new.get(k) for k in {*old, *new})
    changed = status != row.status or len(data) != (row.size if row.size is not None else len(data))
    return out | {"status": status, "size": len(data), "ms": round(1000 * (time.time() - began), 3), "header_changes": differ, "changed": changed}


def replay(entries: DataFrame, blobs: DataFrame | None = None, workers: int = 4, per_second: float | None = None, hosts: list[str] | None = None, headers: list[str] | None = None, unsafe: bool = False, timeout: float = 30.0, **conditions) -> DataFrame:
    """One row per request sent: recorded and new status, size, time, number of headers that differ, and what failed.

    ``workers`` tasks send at once and share ``per_second`` evenly. Methods that
    change something are sent only if ``unsafe``. A task that is run again sends
    its requests again, so give safe methods or none. Redirects aren't followed.
    """
    rows = for_replay(entries, unsafe, **conditions).select("id", "method", "url", "status", F.col("response_body_size").alias("size"), F.col("time_ms").alias("ms"), "request_headers", "response_headers", F.col("request_body_hash").alias("hash"))
    if blobs is None:
        rows = rows.withColumn("body", F.lit(None).cast("binary"))
    else:
        rows = rows.join(blobs.select("hash", F.col("content").alias("body")), "hash", "left")
    h, x = host_rules(hosts or []), header_rules(headers or [])
    pause = workers / per_second if per_second else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = urllib.request.build_opener(_NoRedirect)
        for b in batches:
            out = []
            for row in b.astype(object).where(b.notna(), None).itertuples(index=False):
                began = time.time()
                out.append(_ask(opener, row, h, x, timeout))
                time.sleep(max(0.0, pause - (time.time() - began)))
            cols = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pd.DataFrame(out, columns=cols, dtype=object)

    return rows.repartition(workers).mapInPandas(run, SCHEMA)


def answer_headers(headers: str | None, encoded: bool) -> dict[str, str]:
    """Headers to answer with: those of one connection left out, the encoding kept only if the body is still encoded."""
    out = {k: v for k, v in json.loads(headers or "{}").items() if k.lower() not in HOP_BY_HOP}
    return out if encoded else {k: v for k, v in out.items() if k.lower() != "content-encoding"}


def server(entries: DataFrame, blobs: DataFrame, address: tuple[str, int] = ("127.0.0.1", 8080), mode: str = "strict") -> ThreadingHTTPServer:
    """A server that answers with the latest recording of each request (its method and URL, in 'fuzzy' mode without the query).

    Meant for small stores: the recordings that answer are held in memory.
    """
    last: dict[tuple[str, str], dict] = {}
    cut = (lambda u: u) if mode == "strict" else (lambda u: u.split("?")[0].rstrip("/"))
    rows = entries.where("method is not null and url is not null").select("id", "method", "url", "status", "response_headers", F.coalesce("response_body_hash_raw", "response_body_hash").alias("hash"), F.col("response_body_hash_raw").isNotNull().alias("encoded"), "started_at")
    rows = rows.join(blobs.select("hash", "content"), "hash", "left").orderBy(F.asc_nulls_first("started_at"), "id")
    for r in rows.toLocalIterator():
        u = urlsplit(r.url)
        last[r.method.upper(), cut(urlunsplit(("", "", u.path or "/", u.query, "")))] = r.asDict()

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            r = last.get((self.command, cut(self.path)))
            body = b"" if r is None or r["content"] is None else bytes(r["content"])
            self.send_response(404 if r is None else r["status"] or 200)
            for k, v in ({} if r is None else answer_headers(r["response_headers"], r["encoded"])).items():
                self.send_header(k, v)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(body)

        do_GET = do_HEAD = do_POST = do_PUT = do_DELETE = do_PATCH = do_OPTIONS = answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(address, Handler)
