"""Ad-hoc read-only SQL over tables."""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession


def single_statement(text: str) -> str:
    """The statement without its final semicolon; more than one statement, or none, is an error.

    Semicolons inside quotes and comments don't count.
    """
    bare = re.sub(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", lambda m: (" " if m[0][0] in "-/" else "x") * len(m[0]), text, flags=re.S)
    body = bare.rstrip()
    while body.endswith(";"):
        body = body[:-1].rstrip()
    if not body.strip():
        raise ValueError("empty statement")
    if ";" in body:
        raise ValueError("only one statement is allowed")
    return text[: len(body)].strip()


_SHOWN = ("EXPLAIN", "DESCRIBE", "DESC", "SHOW")
_QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)


def adapted(text: str) -> str:
    """LIKE without regard to case, and GLOB (``*``, ``?``, sets) as a regular expression; quoted text stays as it is."""
    parts, last = [], 0
    for m in _QUOTED.finditer(text):
        parts += [text[last : m.start()], m[0]]
        last = m.end()
    parts.append(text[last:])
    for i in range(0, len(parts), 2):
        parts[i] = re.sub(r"\bLIKE\b", "ILIKE", parts[i], flags=re.I)
        if i + 1 < len(parts) and re.search(r"\bGLOB\s*$", parts[i], re.I) and parts[i + 1][0] == "'":
            parts[i] = re.sub(r"\bGLOB\s*$", "RLIKE ", parts[i], flags=re.I)
            body = parts[i + 1][1:-1].replace("''", "'")
            new = re.sub(r"\[(\^?)([^\]]*)\]|.", lambda m: m[0] if m[0][0] == "[" and len(m[0]) > 1 else ".*" if m[0] == "*" else "." if m[0] == "?" else re.escape(m[0]), body, flags=re.S)
            parts[i + 1] = "'(?s)^" + new.replace("\\", "\\\\").replace("'", "\\'") + "$'"
    return "".join(parts)


def run_query(spark: SparkSession, text: str, tables: dict[str, DataFrame], limit: int | None = None, offset: int | None = None) -> DataFrame:
    """A query over the given tables. Commands that would change anything are refused by their plan; EXPLAIN, DESCRIBE and SHOW are let through."""
    text = adapted(single_statement(text))
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    if text.split(None, 1)[0].upper() not in _SHOWN:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
        seen = [plan]
        while seen:
            node = seen.pop()
            cls = node.getClass().getName()
            if ".command." in cls or "Command" in cls or "CreateTable" in cls or "InsertInto" in cls or ".Drop" in cls or ".Alter" in cls or "Merge" in cls or "Delete" in cls or "Update" in cls or ".Set" in cls.replace("SetOperation", ""):
                raise ValueError("only queries are allowed")
            kids = node.children()
            seen += [kids.apply(i) for i in range(kids.size())]
    df = spark.sql(text)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def render(columns: list[str], rows: Iterable[Row], form: str = "table") -> str:
    """Rows as a table, CSV or JSON text."""
    if form == "json":
        return json.dumps([dict(zip(columns, r)) for r in rows], default=str, ensure_ascii=False)
    if form == "csv":
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(columns)
        w.writerows(["" if v is None else v for v in r] for r in rows)
        return out.getvalue()
    cells = [[cell(v) for v in r] for r in rows]
    width = [max(len(c), *(len(r[i]) for r in cells)) if cells else len(c) for i, c in enumerate(columns)]
    line = lambda r: "  ".join(v.ljust(n) for v, n in zip(r, width)).rstrip()
    return "\n".join([line(columns), "  ".join("-" * n for n in width), *map(line, cells)]) + "\n"


def cell(v, most: int | None = 80) -> str:
    """A value as it is shown in a table; longer ones end in an ellipsis, binary ones tell their size."""
    if v is None:
        return "NULL"
    if isinstance(v, (bytes, bytearray)):
        return f"<blob {len(v)} bytes>"
    t = str(v)
    return t if most is None or len(t) <= most else t[: most - 3] + "..."
