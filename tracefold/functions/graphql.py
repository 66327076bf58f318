"""The operation and top-level fields of a GraphQL document, by a small scanner."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r'#[^\n]*|"""(?:[^"]|"(?!""))*"""|"(?:\\.|[^"\\\n])*"|\.\.\.|[{}()\[\]:!$@=|&]|[A-Za-z_]\w*|-?\d[\w.+-]*|\S')


def _skip(t: list[str], i: int, opening: str, closing: str) -> int:
    depth = 0
    while i < len(t):
        depth += (t[i] == opening) - (t[i] == closing)
        i += 1
        if not depth:
            break
    return i


def _selection(t: list[str], i: int) -> tuple[list, int]:
    """Items of the set that opens at i: field names, ('spread', name) or ('inline', items)."""
    out: list = []
    i += 1
    while i < len(t) and t[i] != "}":
        if t[i] == "...":
            if i + 1 < len(t) and re.match(r"\w", t[i + 1]) and t[i + 1] != "on":
                out.append(("spread", t[i + 1]))
                i += 2
            else:
                i += 3 if i + 1 < len(t) and t[i + 1] == "on" else 1
                while i < len(t) and t[i] == "@":
                    i = _directive(t, i)
                if i < len(t) and t[i] == "{":
                    items, i = _selection(t, i)
                    out.append(("inline", items))
        elif re.match(r"[A-Za-z_]", t[i]):
            name = t[i]
            i += 1
            if i + 1 < len(t) and t[i] == ":":
                name = t[i + 1]
                i += 2
            if i < len(t) and t[i] == "(":
                i = _skip(t, i, "(", ")")
            while i < len(t) and t[i] == "@":
                i = _directive(t, i)
            if i < len(t) and t[i] == "{":
                i = _skip(t, i, "{", "}")
            out.append(name)
        else:
            i += 1
    return out, i + 1


def _directive(t: list[str], i: int) -> int:
    i += 2
    return _skip(t, i, "(", ")") if i < len(t) and t[i] == "(" else i


def parse(document: str | None, wanted: str | None = None) -> dict | None:
    """Type, name and top-level field names of the operation: the named, the only, an anonymous or the first one.

    Aliases are resolved to fields, fragments expanded once each (so loops end).
    NULL, empty or unreadable documents give None.
    """
    t = [x for x in _TOKEN.findall(document or "") if x[0] not in '#",']
    operations, fragments, i = [], {}, 0
    while i < len(t):
        if t[i] == "{":
            items, i = _selection(t, i)
            operations.append(("query", None, items))
        elif t[i] in ("query", "mutation", "subscription", "fragment"):
            kind, name = t[i], None
            i += 1
            if i < len(t) and re.match(r"[A-Za-z_]", t[i]):
                name = t[i]
                i += 1
            while i < len(t) and t[i] != "{":
                i = _skip(t, i, "(", ")") if t[i] == "(" else i + 1
            if i < len(t):
                items, i = _selection(t, i)
                if kind == "fragment":
                    fragments[name] = items
                else:
                    operations.append((kind, name, items))
        else:
            i += 1
    if not operations:
        return None
    pick = next((o for o in operations if wanted and o[1] == wanted), None) or (operations[0] if len(operations) == 1 else next((o for o in operations if o[1] is None), operations[0]))
    fields: dict[str, None] = {}
    seen: set[str] = set()

    def take(items: list) -> None:
        for x in items:
            if isinstance(x, str):
                fields[x] = None
            elif x[0] == "inline":
                take(x[1])
            elif x[1] not in seen:
                seen.add(x[1])
                take(fragments.get(x[1], []))

    take(pick[2])
    return {"type": pick[0], "name": pick[1], "fields": list(fields)}


def _json(text: str | None):
    import json

    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


def _payload(v) -> dict | None:
    """Query, name and persisted query of a payload; of several the first."""
    if isinstance(v, list):
        v = v[0] if v else None
    if not isinstance(v, dict):
        return None
    ext = v.get("extensions")
    if isinstance(ext, str):
        ext = _json(ext)
    persisted = isinstance(ext, dict) and "persistedQuery" in ext
    query, name = (v.get(k) if isinstance(v.get(k), str) and v.get(k) else None for k in ("query", "operationName"))
    return {"query": query, "name": name} if query or name or persisted else None


def detect(url: str | None, mime: str | None, body: str | None, params: list[tuple[str, str]] | None = None) -> dict | None:
    """Type, name and fields of a request if it is GraphQL, else None.

    It is if its content type or path says so, or a query, an operation's name or
    a persisted query is found. They are looked for in the URL's parameters,
    then in posted ones, then in the body, by its type. A request whose document
    isn't given has its name only.
    """
    from urllib.parse import parse_qsl, urlsplit

    try:
        u = urlsplit(url or "")
        path, query = u.path.lower(), dict(reversed(parse_qsl(u.query, keep_blank_values=True)))
    except ValueError:
        path, query = "", {}
    kind = (mime or "").lower()
    said = "graphql" in kind or "graphql" in path or "gql" in path
    got = _payload(query) or _payload(dict(reversed(params or [])))
    if got is None and body:
        head = body.lstrip()[:1]
        if "graphql" in kind and "json" not in kind:
            got = {"query": body, "name": None}
        elif "x-www-form-urlencoded" in kind:
            got = _payload(dict(reversed(parse_qsl(body, keep_blank_values=True))))
        elif "json" in kind or head in ("{", "["):
            got = _payload(_json(body))
    if got is None and not said:
        return None
    op = parse(got["query"], got["name"]) if got and got["query"] else None
    if op is None:
        name = got["name"] if got else None
        return {"type": None, "name": name, "fields": None} if name or said else None
    return {"type": op["type"], "name": op["name"] or got["name"], "fields": op["fields"]}


SCHEMA = T.StructType([T.StructField("type", T.StringType()), T.StructField("name", T.StringType()), T.StructField("fields", T.ArrayType(T.StringType()))])
_NONE = {"type": None, "name": None, "fields": None}


def operations(requests: DataFrame, key: str, url: str, mime: str, body: str) -> DataFrame:
    """``key``, ``type``, ``name`` and ``fields`` of the requests that are GraphQL.

    Only those that may be one (by their type, URL or the look of the body) leave
    the JVM, and equal ones are read once each.
    """
    c = lambda n: F.coalesce(F.col(n), F.lit(""))
    may = F.lower(c(mime)).contains("graphql") | F.lower(c(url)).rlike("graphql|gql|[?&](query|operationname|extensions)=") | c(body).rlike("query|operationName|persistedQuery")
    rows = requests.select(key, F.col(url).alias("__u"), F.col(mime).alias("__m"), F.col(body).alias("__b")).where(may)

    @F.pandas_udf(SCHEMA)
    def run(u: pd.Series, m: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([detect(*x) or _NONE for x in zip(u, m, b)], columns=["type", "name", "fields"])

    distinct = rows.select("__u", "__m", "__b").distinct().withColumn("g", run("__u", "__m", "__b"))
    same = F.lit(True)
    for n in ("__u", "__m", "__b"):
        same = same & F.col(f"r.{n}").eqNullSafe(F.col(f"d.{n}"))
    return rows.alias("r").join(distinct.alias("d"), same).select(f"r.{key}", "d.g.type", "d.g.name", "d.g.fields").where("type is not null or name is not null")


def field_rows(found: DataFrame, key: str) -> DataFrame:
    """One row per operation and top-level field: ``entry_id``, ``field``."""
    return found.select(F.col(key).alias("entry_id"), F.explode("fields").alias("field")).distinct()
