"""Predicates over entries: a description of conditions that becomes one Column."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_size(text: str) -> int | None:
    """Bytes of a size such as ``1.5MB`` or ``100k`` (steps of 1024); None for ``unlimited``."""
    t = text.strip().lower()
    if t in ("unlimited", "none"):
        return None
    m = re.fullmatch(r"(\d+(?:\.\d*)?|\.\d+)\s*([kmgt]?)(?:i?b)?", t)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return round(float(m[1]) * 1024 ** " kmgt".index(m[2] or " "))


def time_bound(text: str, end: bool = False) -> str:
    """The UTC text that ``started_at`` is compared with; a date as end means its last millisecond."""
    try:
        d = date.fromisoformat(text)
        if len(text) == 10:
            return f"{d}T23:59:59.999Z" if end else f"{d}T00:00:00.000Z"
    except ValueError:
        pass
    t = datetime.fromisoformat(text.replace("Z", "+00:00").replace("z", "+00:00"))
    t = (t if t.tzinfo else t.replace(tzinfo=timezone.utc)).astimezone(timezone.utc)
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


def next_midnight(day: str) -> str:
    """The exclusive end of a day, for imports."""
    return f"{date.fromisoformat(day) + timedelta(days=1)}T00:00:00.000Z"


def url_extension(url: Column) -> Column:
    """The extension of the last path segment in lower case, NULL without one; a trailing dot gives ''."""
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last.contains("."), F.lower(F.element_at(F.split(last, r"\."), -1)))


def names_match(value: Column, patterns: list[str], mode: str = "wildcard") -> Column:
    """Does a name match one of the patterns: exact, wildcard (``*`` and ``?``) or regex, without regard to case?"""
    out = F.lit(False)
    for p in patterns:
        if mode == "exact":
            out = out | (F.lower(value) == p.lower())
        else:
            body = p if mode == "regex" else "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + "$"
            out = out | value.rlike("(?i)" + body)
    return out


def like(c: Column, needle: str) -> Column:
    """Does the text hold the needle, without regard to case? ``%`` and ``_`` in it are wildcards, a backslash is itself."""
    return c.ilike("%" + needle.replace("\\", "\\\\") + "%")


def safe_method(method: Column) -> Column:
    """Methods that change nothing."""
    return F.upper(method).isin("GET", "HEAD", "OPTIONS", "TRACE")


@dataclass
class EntryFilter:
    """Conditions on entries; those of one kind are alternatives, kinds add up."""

    import_ids: list[int] = field(default_factory=list)
    since: str | None = None
    until: str | None = None
    urls: list[str] = field(default_factory=list)
    url_contains: list[str] = field(default_factory=list)
    url_regex: list[str] = field(default_factory=list)
    hosts: list[str] = field(default_factory=list)
    methods: list[str] = field(default_factory=list)
    statuses: list[int] = field(default_factory=list)
    mime_contains: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    min_request: int | None = None
    max_request: int | None = None
    min_response: int | None = None
    max_response: int | None = None

    def column(self) -> Column:
        """One predicate. Equality and ranges reach the scan; patterns stay in a Filter."""
        c = F.lit(True)
        any_of = lambda cols: F.lit(False) if not cols else cols[0] if len(cols) == 1 else cols[0] | any_of(cols[1:])
        for name, values in (("import_id", self.import_ids), ("url", self.urls), ("host", self.hosts), ("method", self.methods), ("status", self.statuses)):
            if values:
                c = c & F.col(name).isin(values)
        if self.since:
            c = c & (F.col("started_at") >= time_bound(self.since))
        if self.until:
            c = c & (F.col("started_at") <= time_bound(self.until, end=True))
        if self.url_contains:
            c = c & any_of([like(F.col("url"), n) for n in self.url_contains])
        if self.url_regex:
            c = c & any_of([F.col("url").rlike(p) for p in self.url_regex])
        if self.mime_contains:
            c = c & any_of([F.lower("response_mime_type").contains(n.lower()) for n in self.mime_contains])
        if self.extensions:
            c = c & url_extension(F.col("url")).isin([x.lower().lstrip(".") for s in self.extensions for x in s.split(",")])
        for name, low, high in (("request_body_size", self.min_request, self.max_request), ("response_body_size", self.min_response, self.max_response)):
            size = F.coalesce(F.col(name), F.lit(0))
            if low is not None:
                c = c & (size >= low)
            if high is not None:
                c = c & (size <= high)
        return c

    def apply(self, entries: DataFrame) -> DataFrame:
        return entries.where(self.column())


def from_sources(entries: DataFrame, imports: DataFrame, sources: list[str] | None = None, contains: list[str] | None = None) -> DataFrame:
    """Entries of imports whose file is one of ``sources`` or ends with it, and holds one of ``contains``."""
    s = F.regexp_replace("source_file", r"\\", "/")
    hit = F.lit(not sources)
    for x in sources or []:
        x = x.replace("\\", "/")
        hit = hit | (s == x) | s.endswith("/" + x)
    part = F.lit(not contains)
    for x in contains or []:
        part = part | like(F.col("source_file"), x)
    ids = imports.where(hit & part).select(F.col("id").alias("import_id"))
    return entries.join(ids, "import_id", "left_semi")


def on_import(entries: DataFrame, hosts: list[str] | None = None, methods: list[str] | None = None, statuses: list[int] | None = None, url_regex: list[str] | None = None, since_us: int | None = None, until_us: int | None = None, start_us: str = "start_us") -> DataFrame:
    """Entries to be loaded: host and method without regard to case, instants from ``since_us`` to before ``until_us``.

    ``start_us`` is the column of instants; an unreadable start fails only if a bound is given.
    """
    c = F.lit(True)
    if hosts:
        c = c & F.lower("host").isin([h.lower() for h in hosts])
    if methods:
        c = c & F.upper("method").isin([m.upper() for m in methods])
    if statuses:
        c = c & F.col("status").isin(statuses)
    if url_regex:
        c = c & F.col("url").rlike("|".join(f"(?:{p})" for p in url_regex))
    if since_us is not None or until_us is not None:
        at = F.coalesce(F.col(start_us), F.raise_error(F.concat(F.lit("unreadable start: "), F.coalesce("started_at", F.lit("NULL")))).cast("long"))
        c = c & (at >= since_us if since_us is not None else F.lit(True)) & (at < until_us if until_us is not None else F.lit(True))
    return entries.where(c)


def for_diff(entries: DataFrame, hosts: list[str] | None = None, methods: list[str] | None = None, statuses: list[int] | None = None, url_regex: list[str] | None = None) -> DataFrame:
    """Entries to be compared: hosts as written (of the URL where the column is NULL), methods without regard to case; an empty URL matches no pattern."""
    from tracefold.operators.views import host_of

    c = F.lit(True)
    if hosts:
        c = c & F.lower(host_of()).isin([h.lower() for h in hosts])
    if methods:
        c = c & F.upper("method").isin([m.upper() for m in methods])
    if statuses:
        c = c & F.col("status").isin(statuses)
    if url_regex:
        c = c & (F.coalesce("url", F.lit("")) != "") & F.col("url").rlike("|".join(f"(?:{p})" for p in url_regex))
    return entries.where(c)


def for_replay(entries: DataFrame, unsafe: bool = False, **conditions) -> DataFrame:
    """Entries that may be sent again: with a URL and method, only methods that change nothing unless ``unsafe``, and the conditions of ``for_diff``."""
    rows = for_diff(entries, **conditions).where("url is not null and method is not null")
    return rows if unsafe else rows.where(safe_method(F.col("method")))


def for_report(entries: DataFrame, url_contains: list[str] | None = None, extensions: list[str] | None = None, **conditions) -> DataFrame:
    """Entries of a report on a capture: URL parts with regard to case, extensions split at commas, the rest as in ``for_diff``."""
    c = F.lit(True)
    if url_contains:
        hit = F.lit(False)
        for x in url_contains:
            hit = hit | F.col("url").contains(x)
        c = c & hit
    if extensions:
        c = c & url_extension(F.col("url")).isin([y.lower().lstrip(".") for x in extensions for y in x.split(",")])
    return for_diff(entries, **conditions).where(c)


def page_matches(page_id: Column, title: Column, needle: str) -> Column:
    """Does a page's id or title hold the needle, blanks at its ends and case aside?"""
    n = needle.strip().lower()
    return F.coalesce(F.lower(page_id).contains(n), F.lit(False)) | F.coalesce(F.lower(title).contains(n), F.lit(False))


def stable_sample(df: DataFrame, key: list[str], rate: float) -> DataFrame:
    """The same share of rows every time: those whose key's digest (its first 64 bits) falls within the rate."""
    text = F.concat_ws("", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key))
    if rate >= 1:
        return df
    if rate <= 0:
        return df.where(F.lit(False))
    return df.where(F.substring(F.sha2(text, 256), 1, 16) <= f"{int(rate * 2**64):016x}")
