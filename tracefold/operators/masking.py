"""Masking by name and by pattern, the plain scan for personal data, and what it reports."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracefold.operators.filters import names_match

# Headers and cookies that are masked unless told otherwise.
DEFAULT_HEADERS = ["authorization", "proxy-authorization", "cookie", "set-cookie", "x-api-key", "api-key", "x-auth-token", "x-csrf-token", "csrf-token", "x-xsrf-token"]
DEFAULT_COOKIES = ["*"]
# Patterns of the plain scan, in the order in which they are applied.
PATTERNS = {
    "email": r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b",
    "phone": r"\b(?:\+?1[\s.-]?)?(?:\(?[2-9]\d{2}\)?[\s.-]?)\d{3}[\s.-]?\d{4}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "credit_card": r"\b(?:\d[ -]*?){13,19}\b",
}
TOKEN = "REDACTED"


def chosen(headers: list[str] | None, cookies: list[str] | None, params: list[str] | None, bodies: list[str] | None, mode: str = "wildcard", defaults: bool = True) -> dict[str, list[str]]:
    """What to mask: names as given and, in wildcard mode unless declined, the default ones. Nothing to mask is an error."""
    out = {"headers": list(headers or []), "cookies": list(cookies or []), "params": list(params or []), "bodies": list(bodies or [])}
    if defaults and mode == "wildcard":
        out["headers"] = DEFAULT_HEADERS + out["headers"]
        out["cookies"] = DEFAULT_COOKIES + out["cookies"]
    if not any(out.values()):
        raise ValueError("nothing to mask: give names or patterns")
    return out


def _map(json: Column) -> Column:
    return F.from_json(json, "map<string,string>")


def mask_headers(headers: Column, patterns: list[str], token: str = TOKEN, mode: str = "wildcard") -> Column:
    """A JSON object of headers with the values of matching names replaced; left as it is where none matches."""
    m = _map(headers)
    return F.when(F.size(masked_headers(headers, patterns, token, mode)) > 0, F.to_json(F.transform_values(m, lambda k, v: F.when(names_match(k, patterns, mode), F.lit(token)).otherwise(v)))).otherwise(headers)


def masked_headers(headers: Column, patterns: list[str], token: str = TOKEN, mode: str = "wildcard") -> Column:
    """Names of headers that ``mask_headers`` would change; values that are the token already don't count."""
    return F.map_keys(F.map_filter(_map(headers), lambda k, v: names_match(k, patterns, mode) & ~v.eqNullSafe(F.lit(token))))


def _cookies(json: Column) -> Column:
    return F.from_json(json, "array<map<string,string>>")


def mask_cookies(cookies: Column, patterns: list[str], token: str = TOKEN, mode: str = "wildcard") -> Column:
    """A JSON array of cookies with the values of matching names replaced, other attributes kept."""
    new = F.transform(_cookies(cookies), lambda c: F.when(names_match(c["name"], patterns, mode), F.transform_values(c, lambda k, v: F.when(k == "value", F.lit(token)).otherwise(v))).otherwise(c))
    return F.when(F.size(masked_cookies(cookies, patterns, token, mode)) > 0, F.to_json(new)).otherwise(cookies)


def masked_cookies(cookies: Column, patterns: list[str], token: str = TOKEN, mode: str = "wildcard") -> Column:
    hit = F.filter(_cookies(cookies), lambda c: names_match(c["name"], patterns, mode) & ~c["value"].eqNullSafe(F.lit(token)))
    return F.transform(hit, lambda c: c["name"])


def form_pairs(query: Column) -> Column:
    """A query string or form as an array of decoded (name, value); empty parts are left out."""
    cut = lambda kv: F.struct(F.try_url_decode(F.split_part(kv, F.lit("="), F.lit(1))).alias("name"), F.try_url_decode(F.regexp_replace(F.regexp_extract(kv, "=(.*)$", 1), "\\+", " ")).alias("value"))
    return F.transform(F.filter(F.split(query, "&"), lambda kv: kv != ""), cut)


def form_text(pairs: Column) -> Column:
    """Pairs as an encoded form."""
    return F.array_join(F.transform(pairs, lambda x: F.concat(F.url_encode(x["name"]), F.lit("="), F.url_encode(F.coalesce(x["value"], F.lit(""))))), "&")


def mask_params(url: Column, patterns: list[str], token: str = TOKEN, mode: str = "wildcard") -> dict[str, Column]:
    """``url`` and ``query`` with the values of matching parameters replaced, ``changed`` and the ``names`` that matched.

    Names are compared decoded, and the query is encoded anew if anything
    changes; a URL without a match stays as it is.
    """
    query = F.nullif(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    pairs = form_pairs(query)
    hit = F.filter(pairs, lambda x: names_match(x["name"], patterns, mode))
    changed = F.coalesce(F.size(F.filter(hit, lambda x: x["value"] != token)), F.lit(0))
    new = form_text(F.transform(pairs, lambda x: F.struct(x["name"].alias("name"), F.when(names_match(x["name"], patterns, mode), F.lit(token)).otherwise(x["value"]).alias("value"))))
    whole = F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), F.lit("?"), new, F.regexp_extract(url, r"(#.*)$", 1))
    return {"url": F.when(changed > 0, whole).otherwise(url), "query": F.when(changed > 0, new).otherwise(query), "changed": changed, "names": F.array_distinct(F.transform(hit, lambda x: x["name"]))}


def mask_text(text: Column, patterns: list[str], token: str = TOKEN) -> Column:
    """Matches of each pattern in turn replaced by the token as it is written."""
    plain = token.replace("\\", "\\\\").replace("$", "\\$")
    for p in patterns:
        text = F.regexp_replace(text, p, plain)
    return text


def redact_entries(entries: DataFrame, what: dict[str, list[str]], token: str = TOKEN, mode: str = "wildcard") -> DataFrame:
    """Entries with headers, cookies and URL parameters masked. All columns pass through, whatever their number or names."""
    h, c, p = what["headers"], what["cookies"], what["params"]
    new: dict[str, Column] = {}
    for side in ("request", "response"):
        if h:
            new[f"{side}_headers"] = mask_headers(F.col(f"{side}_headers"), h, token, mode)
        if c:
            new[f"{side}_cookies"] = mask_cookies(F.col(f"{side}_cookies"), c, token, mode)
    if p:
        m = mask_params(F.col("url"), p, token, mode)
        new |= {"url": m["url"], "query_string": F.when(m["changed"] > 0, m["query"]).otherwise(F.col("query_string"))}
    return entries.withColumns(new) if new else entries


def redact_bodies(entries: DataFrame, blobs: DataFrame, patterns: list[str], token: str = TOKEN) -> tuple[DataFrame, DataFrame]:
    """Entries and blobs with the patterns replaced in bodies of valid UTF-8.

    Each blob is searched once. A changed body becomes a new blob under its own
    hash, entries point to it, its size is set and the raw variant cleared; blobs
    of other entries stay.
    """
    text = F.col("content").cast("string")
    new = blobs.where(F.is_valid_utf8(text)).select(F.col("hash").alias("old"), text.alias("t"), mask_text(text, patterns, token).alias("n"), "mime_type").where(F.col("t") != F.col("n"))
    new = new.select("old", F.encode("n", "UTF-8").alias("content"), "mime_type").withColumn("hash", F.sha2("content", 256)).withColumn("size", F.octet_length("content").cast("long"))
    moved = new.select("old", F.col("hash").alias("to"), F.col("size").alias("n"))
    e = entries
    for side in ("request", "response"):
        j = e.join(moved.select(F.col("old").alias(f"{side}_body_hash"), F.col("to").alias("__to"), F.col("n").alias("__n")), f"{side}_body_hash", "left")
        cols = {f"{side}_body_hash": F.coalesce("__to", f"{side}_body_hash"), f"{side}_body_size": F.coalesce("__n", f"{side}_body_size")}
        if side == "response":
            cols |= {k: F.when(F.col("__to").isNull(), F.col(k)) for k in ("response_body_hash_raw", "response_body_size_raw")}
        e = j.withColumns(cols).drop("__to", "__n").select(*entries.columns)
    added = new.groupBy("hash").agg(F.first("content").alias("content"), F.max("size").alias("size"), F.first("mime_type").alias("mime_type")).join(blobs.select("hash"), "hash", "left_anti")
    return e, blobs.unionByName(added, allowMissingColumns=True)


def redaction_report(entries: DataFrame, what: dict[str, list[str]], token: str = TOKEN, mode: str = "wildcard") -> DataFrame:
    """What a redaction would change: values of headers, cookies and parameters, and the sorted names that matched."""
    none = F.array().cast("array<string>")
    p = mask_params(F.col("url"), what["params"] or ["\x00"], token, mode)
    names = lambda f, key, cols: F.concat(*(F.coalesce(f(F.col(c), what[key], token, mode), none) for c in cols)) if what[key] else none
    rows = entries.select(names(masked_headers, "headers", ("request_headers", "response_headers")).alias("h"), names(masked_cookies, "cookies", ("request_cookies", "response_cookies")).alias("c"), p["changed"].alias("n"), F.coalesce(p["names"], none).alias("p"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    # names first combine to distinct ones in every task, so no group gathers all of them
    sorted_names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(c))))), ",")
    return rows.agg(total(F.size("h")).alias("headers"), total(F.size("c")).alias("cookies"), total("n").alias("params"), sorted_names("h").alias("header_names"), sorted_names("c").alias("cookie_names"), sorted_names("p").alias("param_names"))


def _valid_cards(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERNS["credit_card"]), F.lit(0))
    bare = F.transform(found, lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return F.filter(bare, lambda x: F.length(x).between(13, 19) & F.call_function("luhn_check", x))


def pattern_matches(text: Column) -> Column:
    """Per kind the number of matches, cards only with a valid check digit: array of (kind, n)."""
    n = {k: F.regexp_count(text, F.lit(p)) for k, p in PATTERNS.items()} | {"credit_card": F.size(_valid_cards(text))}
    return F.array(*(F.struct(F.lit(k).alias("kind"), c.cast("long").alias("n")) for k, c in n.items()))


def pattern_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """How often each kind occurs, where it does."""
    return df.select(key, F.explode(pattern_matches(F.col(text))).alias("x")).select(key, "x.kind", "x.n").where(F.col("n") > 0)


def valid_cards(df: DataFrame, key: str, text: str) -> DataFrame:
    """Runs of 13 to 19 digits, blanks and hyphens allowed between, whose check digit holds."""
    return df.select(key, F.size(_valid_cards(F.col(text))).cast("long").alias("n")).where(F.col("n") > 0)


def findings(entries: DataFrame, blobs: DataFrame) -> DataFrame:
    """Matches by entry, location (url, request, response) and kind, with their places in the reporting order.

    Bodies are searched once each, however many entries have them, if they are
    valid UTF-8. Order by ``id``, ``location_no``, ``kind_no``.
    """
    text = F.col("content").cast("string")
    b = blobs.where(F.is_valid_utf8(text)).select("hash", F.explode(pattern_matches(text)).alias("x")).where("x.n > 0")
    parts = [entries.select("id", F.lit("url").alias("location"), F.explode(pattern_matches(F.col("url"))).alias("x")).where("x.n > 0")]
    for side in ("request", "response"):
        parts.append(entries.select("id", F.col(f"{side}_body_hash").alias("hash")).where("hash is not null").join(b, "hash").select("id", F.lit(side).alias("location"), "x"))
    rows = reduce(DataFrame.unionByName, parts).select("id", "location", "x.kind", "x.n")
    at = lambda c, names: F.array_position(F.array(*map(F.lit, names)), c).cast("int")
    return rows.withColumns({"location_no": at(F.col("location"), ["url", "request", "response"]), "kind_no": at(F.col("kind"), list(PATTERNS))})


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mask_personal(text: Column, token: str = TOKEN) -> Column:
    """Mail addresses, telephone numbers, social security numbers and valid cards replaced, in that order, each on what the last has left."""
    import re

    card = re.compile(PATTERNS["credit_card"])

    def one(m: re.Match) -> str:
        d = re.sub(r"[^0-9]", "", m[0])
        return token if 13 <= len(d) <= 19 and _luhn(d) else m[0]

    @F.pandas_udf(T.StringType())
    def cards(t: pd.Series) -> pd.Series:
        return t.map(lambda s: card.sub(one, s), na_action="ignore")

    text = mask_text(text, [PATTERNS[k] for k in ("email", "phone", "ssn")], token)
    # most texts hold no run of thirteen digits and never leave the JVM
    return F.when(text.rlike(PATTERNS["credit_card"]), cards(F.when(text.rlike(PATTERNS["credit_card"]), text))).otherwise(text)


def check_options(redact: bool, output: str | None = None, force: bool = False, dry_run: bool = False) -> None:
    """``output``, ``force`` and ``dry_run`` mean nothing unless something is redacted."""
    if not redact and (output or force or dry_run):
        raise ValueError("output, force and dry-run need redact")
