"""The surface of an API as seen in its traffic: operations, types, schemas, one document."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.functions.bodies import text_mime
from tracefold.operators.analysis import header
from tracefold.operators.views import server_base, url_parts


def content_type(value: Column) -> Column:
    """A type before its parameters, in lower case, NULL if nothing is left."""
    return F.nullif(F.lower(F.trim(F.split_part(value, F.lit(";"), F.lit(1)))), F.lit(""))


def calls(entries: DataFrame) -> DataFrame:
    """Entries as calls: ``id``, ``path``, ``method``, ``status``, ``request_type``, ``response_type``, ``server``, ``names`` of query parameters."""
    u = url_parts(F.col("url"))
    rows = entries.select(
        "id", u["path"].alias("path"), F.lower("method").alias("method"), "status", content_type(header(F.col("request_headers"), "content-type")).alias("request_type"), F.coalesce(content_type(F.col("response_mime_type")), content_type(header(F.col("response_headers"), "content-type"))).alias("response_type"),
        server_base(F.col("url")).alias("server"), F.filter(F.transform(F.split(u["query"], "&"), lambda kv: F.try_url_decode(F.split_part(kv, F.lit("="), F.lit(1)))), lambda n: n != "").alias("names"), "request_body_hash", "response_body_hash", "request_body_size",
    )
    return rows.where(F.col("path").isNotNull() & F.col("method").isNotNull())


def _joined(c: str) -> Column:
    return F.array_join(F.array_sort(F.collect_set(c)), ",")


def operations(entries: DataFrame) -> DataFrame:
    """By path and method: names of query parameters, types sent, statuses, servers, number of calls."""
    rows = calls(entries)
    names = rows.select("path", "method", F.explode("names").alias("name")).groupBy("path", "method").agg(_joined("name").alias("query_names"))
    sent = F.when(F.col("request_body_size") > 0, F.col("request_type"))
    base = rows.withColumn("sent", sent).groupBy("path", "method").agg(_joined("sent").alias("request_types"), F.array_join(F.array_sort(F.collect_set(F.col("status").cast("string"))), ",").alias("statuses"), _joined("response_type").alias("response_types"), _joined("server").alias("servers"), F.count(F.lit(1)).alias("n"))
    return base.join(names, ["path", "method"], "left")


def answers(entries: DataFrame) -> DataFrame:
    """By path, method and status: types of the answers and how many there were."""
    return calls(entries).groupBy("path", "method", "status").agg(_joined("response_type").alias("response_types"), F.count(F.lit(1)).alias("n"))


def schema_of(value) -> dict:
    """The JSON schema of one value; members that are there are required."""
    if value is None:
        return {"nullable": True}
    if isinstance(value, bool):
        return {"type": "boolean"}
    if isinstance(value, int):
        return {"type": "integer"}
    if isinstance(value, float):
        return {"type": "number"}
    if isinstance(value, str):
        return {"type": "string"}
    if isinstance(value, list):
        items: dict = {}
        for v in value:
            items = merged(items, schema_of(v)) if items else schema_of(v)
        return {"type": "array", "items": items}
    return {"type": "object", "properties": {k: schema_of(v) for k, v in sorted(value.items())}, "required": sorted(value)}


def merged(a: dict, b: dict) -> dict:
    """The least schema that both fit: integers become numbers, objects keep all members and require the common ones, others become alternatives.

    Merging is commutative and associative, so parts can be merged in any order.
    """
    null = a.get("nullable", False) or b.get("nullable", False)
    kinds: dict[str, dict] = {}
    for s in [*(a.get("anyOf") or [a]), *(b.get("anyOf") or [b])]:
        s = {k: v for k, v in s.items() if k != "nullable"}
        kind = s.get("type")
        if kind is None:
            continue
        if kind in ("integer", "number") and {"integer", "number"} & set(kinds):
            other = "integer" if "integer" in kinds else "number"
            if kind != other:
                kinds.pop(other)
                kinds["number"] = {"type": "number"}
            continue
        if kind not in kinds:
            kinds[kind] = s
        elif kind == "array":
            x, y = kinds[kind]["items"], s["items"]
            kinds[kind] = {"type": "array", "items": merged(x, y) if x and y else x or y}
        elif kind == "object":
            x, y = kinds[kind], s
            props = {k: merged(x["properties"][k], y["properties"][k]) if k in x["properties"] and k in y["properties"] else x["properties"].get(k) or y["properties"][k] for k in sorted({*x["properties"], *y["properties"]})}
            kinds[kind] = {"type": "object", "properties": props, "required": sorted({*x["required"]} & {*y["required"]})}
    parts = [kinds[k] for k in sorted(kinds)]
    out = {} if not parts else parts[0] if len(parts) == 1 else {"anyOf": parts}
    return {**out, "nullable": True} if null else out


def schemas(entries: DataFrame, blobs: DataFrame, side: str = "response") -> DataFrame:
    """By path, method, (status,) the merged JSON schema of all bodies of the side: ``schema`` (JSON), ``bodies``.

    Each body is read once, whatever number of calls have it. Schemas are merged
    within every batch before they are shuffled, and the shuffled ones group by
    group, batch after batch, so a hot operation moves one schema per batch.
    Bodies that are no JSON are left out.
    """
    keys = ["path", "method", *(["status"] if side == "response" else [])]
    rows = calls(entries).select(*keys, F.col(f"{side}_body_hash").alias("hash")).where("hash is not null").distinct()
    text = F.col("content").cast("string")
    b = blobs.where(F.is_valid_utf8(text) & (F.col("mime_type").isNull() | text_mime(F.col("mime_type"))) & text.rlike(r"^\s*[\[{]")).select("hash", text.alias("text"))
    kinds = ", ".join(f"{k} {entries.schema[k].dataType.simpleString() if k == 'status' else 'string'}" for k in keys)

    def parts(batches):
        for pdf in batches:
            got: dict[tuple, list] = {}
            known: dict[str, dict | None] = {}
            for *k, t in pdf[[*keys, "text"]].itertuples(index=False):
                if t not in known:
                    try:
                        known[t] = schema_of(json.loads(t))
                    except (ValueError, RecursionError):
                        known[t] = None
                if (s := known[t]) is not None:
                    k = tuple(None if x != x else x for x in k)
                    old = got.get(k)
                    got[k] = [merged(old[0], s), old[1] + 1] if old else [s, 1]
            yield pd.DataFrame([(*k, json.dumps(s), n) for k, (s, n) in got.items()], columns=[*keys, "schema", "bodies"]).astype({"bodies": "int64"})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict | None = None
        for t in pdf["schema"]:
            out = json.loads(t) if out is None else merged(out, json.loads(t))
        head = pdf[keys].iloc[:1].copy()
        head["schema"], head["bodies"] = json.dumps(out, sort_keys=True), int(pdf["bodies"].sum())
        return head

    p = rows.join(b, "hash").select(*keys, "text").mapInPandas(parts, f"{kinds}, schema string, bodies long")
    return p.groupBy(*keys).applyInPandas(whole, f"{kinds}, schema string, bodies long")


def document(ops: list[dict], answers_: list[dict], schemas_: list[dict] | None = None, title: str = "Captured API", version: str = "1.0.0") -> dict:
    """An OpenAPI 3.0.3 document from grouped rows (one per operation, answer and schema)."""
    paths: dict[str, dict] = {}
    shape = {(s["path"], s["method"], s.get("status")): json.loads(s["schema"]) for s in schemas_ or []}
    servers: set[str] = set()
    for o in sorted(ops, key=lambda x: (x["path"], x["method"])):
        op: dict = {"operationId": f"{o['method']} {o['path']}", "responses": {}}
        names = [n for n in (o.get("query_names") or "").split(",") if n]
        if names:
            op["parameters"] = [{"name": n, "in": "query", "required": False, "schema": {"type": "string"}} for n in names]
        types = [t for t in (o.get("request_types") or "").split(",") if t]
        if types:
            op["requestBody"] = {"content": {t: {"schema": {"type": "string"}} for t in types}}
        paths.setdefault(o["path"], {})[o["method"]] = op
        servers |= {s for s in (o.get("servers") or "").split(",") if s}
    for a in sorted(answers_, key=lambda x: (x["path"], x["method"], x["status"] is None, x["status"] or 0)):
        types = [t for t in (a.get("response_types") or "").split(",") if t]
        schema = shape.get((a["path"], a["method"], a["status"]))
        code = "default" if a["status"] is None else str(a["status"])
        r: dict = {"description": f"{a['n']} answers"}
        if types:
            r["content"] = {t: {"schema": schema if schema and "json" in t else {"type": "string"}} for t in types}
        paths[a["path"]][a["method"]]["responses"][code] = r
    return {"openapi": "3.0.3", "info": {"title": title, "version": version}, "servers": [{"url": s} for s in sorted(servers)], "paths": paths}


def build(entries: DataFrame, blobs: DataFrame, **about) -> dict:
    """The document of a store's API; its size is that of the API, not of the traffic."""
    rows = lambda df: [r.asDict() for r in df.toLocalIterator()]
    return document(rows(operations(entries)), rows(answers(entries)), rows(schemas(entries, blobs)), **about)
