"""SQL to compare with the queries over the store as a whole, its views and its search."""

from __future__ import annotations

from tracefold.operators import masking, store
from tracefold.plans.instant_sql import _ENTRIES, with_us

_M = lambda c: f"CASE WHEN NOT isnan({c}) AND {c} >= 0 THEN {c} END"
_URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?"
_GOOD = f"regexp_matches(url, '{_URL}')"
_PART = lambda k: f"regexp_extract(url, '{_URL}', {k})"
_PATH = f"CASE WHEN {_GOOD} THEN coalesce(nullif({_PART(4)}, ''), '/') END"
_PORT = f"CASE WHEN {_GOOD} THEN nullif({_PART(3)}, '') END"
_SERVER = f"""CASE WHEN {_GOOD} THEN lower({_PART(1)}) || '://' || lower({_PART(2)}) || CASE WHEN {_PART(3)} <> '' AND NOT (lower({_PART(1)}) = 'http' AND {_PART(3)} = '80')
  AND NOT (lower({_PART(1)}) = 'https' AND {_PART(3)} = '443') THEN ':' || {_PART(3)} ELSE '' END END"""
_QUERY = f"CASE WHEN {_GOOD} THEN nullif({_PART(5)}, '') END"
_HOST = f"coalesce(host, CASE WHEN {_GOOD} THEN lower({_PART(2)}) END)"
_LAST = r"split_part(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/', -1)"
_EXT = f"CASE WHEN contains({_LAST}, '.') THEN lower(split_part({_LAST}, '.', -1)) END"
_OPEN = "(SELECT id FROM imports WHERE status <> 'complete' OR status IS NULL)"
_DONE = "(SELECT id FROM imports WHERE status = 'complete')"
_NAV = "upper(method) = 'GET' AND regexp_matches(lower(coalesce(response_mime_type, '')), 'text/html|application/xhtml\\+xml')"
_TYPE = lambda c: f"nullif(lower(trim(split_part({c}, ';', 1))), '')"
_TOKENS = lambda c: rf"list_filter(regexp_split_to_array(lower(strip_accents({c})), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_USED = "SELECT request_body_hash AS hash FROM {0} WHERE request_body_hash IS NOT NULL UNION SELECT response_body_hash FROM {0} WHERE response_body_hash IS NOT NULL UNION SELECT response_body_hash_raw FROM {0} WHERE response_body_hash_raw IS NOT NULL"


def _decoded(c: str) -> str:
    return f"TRY(url_decode({c}))"


def _masked_url() -> str:
    hit = "regexp_matches(lower(p.n), '^(ts|c.d)$')"
    return f"""WITH q AS (SELECT id, url, nullif(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '') AS q FROM entries),
  p AS (SELECT id, url, [{{'n': url_decode(split_part(kv, '=', 1)), 'v': url_decode(replace(regexp_extract(kv, '=(.*)$', 1), '+', ' '))}} for kv in string_split(q, '&') if kv <> ''] AS ps FROM q),
  m AS (SELECT id, url, coalesce(len([p for p in ps if {hit} AND p.v <> 'REDACTED']), 0) AS changed,
    array_to_string([replace(url_encode(p.n), '%20', '+') || '=' || replace(url_encode(CASE WHEN {hit} THEN 'REDACTED' ELSE p.v END), '%20', '+') for p in ps], '&') AS new FROM p)
SELECT id, CASE WHEN changed > 0 THEN regexp_extract(url, '^([^?#]*)', 1) || '?' || replace(replace(new, '%2A', '*'), '~', '%7E') || regexp_extract(url, '(#.*)$', 1) ELSE url END AS url, CAST(changed AS BIGINT) AS changed FROM m"""


def _bm25(words: list[str], rows: str, key: str, cond: str) -> str:
    """BM25 over tokenised ``rows`` (``key``, ``t``) for the documents that ``cond`` (over c0, c1, ...) keeps."""
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS c{i}" for i, w in enumerate(words))
    stats = ", ".join(f"count(*) FILTER (WHERE c{i} > 0) AS d{i}" for i in range(len(words)))
    score = " + ".join(f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * c{i} * 2.2 / (c{i} + 1.2 * (0.25 + 0.75 * l / m))" for i in range(len(words)))
    return f"WITH d AS ({rows}), c AS (SELECT {key}, t, len(t) AS l, {counts} FROM d), s AS (SELECT count(*) AS n, avg(l) AS m, {stats} FROM c WHERE l > 0) SELECT {key}, round(-({score}), 6) AS score FROM c, s WHERE {cond}"


_DOCS = f"SELECT doc_id, {_TOKENS('text')} AS t FROM documents WHERE text IS NOT NULL AND text <> ''"
_BODIES = f"SELECT hash, {_TOKENS('text')} AS t FROM (SELECT hash, TRY(decode(content)) AS text, mime_type FROM blobs WHERE octet_length(content) BETWEEN 1 AND 1048576) WHERE text IS NOT NULL AND text <> '' AND (mime_type IS NULL OR regexp_matches(lower(mime_type), 'text/|json|xml|javascript|css|html|x-www-form-urlencoded'))"
_LINE = "' ' || array_to_string(t, ' ') || ' '"
_PHASE = lambda p: f"({_M(p + '_ms')})"


def _phases() -> str:
    p = {x: f"({_M(x + '_ms')})" for x in ("blocked", "dns", "connect", "ssl", "send", "wait", "receive")}
    z = {x: f"coalesce({c}, 0.0)" for x, c in p.items()}
    alone, nested = f"({p['ssl']} IS NOT NULL AND {p['connect']} IS NULL)", f"({p['ssl']} > 0 AND {p['ssl']} <= {p['connect']})"
    t1 = f"({z['blocked']} + {z['dns']})"
    t2 = f"({t1} + {z['connect']} + CASE WHEN {alone} THEN {z['ssl']} ELSE 0.0 END)"
    rows = [
        ("blocked", "CAST(0 AS DOUBLE)", z["blocked"], f"{p['blocked']} IS NOT NULL"), ("dns", z["blocked"], t1, f"{p['dns']} IS NOT NULL"), ("connect", t1, f"{t1} + {z['connect']}", f"{p['connect']} IS NOT NULL"),
        ("send", t2, f"{t2} + {z['send']}", f"{p['send']} IS NOT NULL"), ("wait", f"{t2} + {z['send']}", f"{t2} + {z['send']} + {z['wait']}", f"{p['wait']} IS NOT NULL"),
        ("receive", f"{t2} + {z['send']} + {z['wait']}", f"{t2} + {z['send']} + {z['wait']} + {z['receive']}", f"{p['receive']} IS NOT NULL"),
        ("ssl", f"CASE WHEN {nested} THEN {t1} + {z['connect']} - {z['ssl']} ELSE {t1} END", f"CASE WHEN {nested} THEN {t1} + {z['connect']} ELSE {t1} + {z['ssl']} END", f"{nested} OR {alone}"),
    ]
    return " UNION ALL ".join(f"SELECT id, '{n}' AS phase, round({a}, 6) AS a, round({b}, 6) AS b FROM entries WHERE {c}" for n, a, b, c in rows)


_SEED = "coalesce(entry_hash, '') || '|' || coalesce(url, '') || '|' || coalesce(started_at, '') || '|' || id"
_WATERFALL = f"""WITH {with_us(_ENTRIES)},
  w0 AS (SELECT u.id, u.import_id, u.page_id, p.title, coalesce(u.url, '<unknown>') AS url, us, CASE WHEN {_NAV.replace('method', 'u.method', 1)} THEN 1 ELSE 0 END AS nav FROM us u LEFT JOIN (SELECT DISTINCT ON (id, import_id) id AS pi, import_id AS pp, title FROM pages) p ON p.pi = u.page_id AND p.pp = u.import_id WHERE us IS NOT NULL),
  w1 AS (SELECT *, row_number() OVER (PARTITION BY import_id, page_id IS NULL ORDER BY us, url, id) AS k, min(us) OVER () AS first_us FROM w0),
  w2 AS (SELECT *, CASE WHEN page_id IS NULL THEN CAST(sum(CASE WHEN k = 1 THEN 1 ELSE nav END) OVER (PARTITION BY import_id, page_id IS NULL ORDER BY us, url, id) AS BIGINT) END AS session FROM w1),
  g AS (SELECT import_id, page_id, session, min(us) AS group_from, arg_min(url, {{'a': us, 'b': url, 'c': id}}) AS opening, coalesce(nullif(trim(first(title)), ''), page_id) AS t FROM w2 GROUP BY 1, 2, 3),
  h AS (SELECT *, import_id || ':' || CASE WHEN page_id IS NOT NULL THEN t ELSE 'Navigation ' || session || ': ' || opening END AS group_name FROM g),
  o AS (SELECT *, row_number() OVER (ORDER BY group_from, group_name, import_id) AS group_no FROM h),
  w AS (SELECT o.group_no, o.group_name, row_number() OVER (PARTITION BY o.group_no ORDER BY us, url, id) AS row_no, id, (us - first_us) // 1000 AS offset_ms FROM w2 JOIN o ON o.import_id = w2.import_id AND o.page_id IS NOT DISTINCT FROM w2.page_id AND o.session IS NOT DISTINCT FROM w2.session)"""


def _ordinals(which: str) -> str:
    return f"SELECT coalesce(upper(method), '') AS method, url, row_number() OVER (PARTITION BY coalesce(upper(method), ''), url ORDER BY started_at NULLS FIRST, id) AS nth, status, response_body_size AS size, {_M('time_ms')} AS ms, {_M('wait_ms')} AS ttfb, request_headers AS rq, response_headers AS rs FROM entries WHERE url IS NOT NULL AND import_id {which} {_DONE}"


_MAP = lambda c: f"CAST(coalesce({c}, '{{}}')::JSON AS MAP(VARCHAR, VARCHAR))"
_HEADS = lambda c: f"(SELECT count(*) FROM (SELECT unnest(list_distinct(list_concat(map_keys({_MAP('j.l_' + c)}), map_keys({_MAP('j.r_' + c)})))) AS k) WHERE {_MAP('j.l_' + c)}[k] IS DISTINCT FROM {_MAP('j.r_' + c)}[k])"
_DIFF = f"""WITH a AS ({_ordinals('IN')}), b AS ({_ordinals('NOT IN')}),
  j0 AS (SELECT coalesce(a.method, b.method) AS method, coalesce(a.url, b.url) AS url, coalesce(a.nth, b.nth) AS nth, a.nth AS la, b.nth AS rb, a.status AS left_status, b.status AS right_status, a.size AS left_size, b.size AS right_size, a.ms AS lm, b.ms AS rm, a.ttfb AS lt, b.ttfb AS rt,
    a.rq AS l_rq, b.rq AS r_rq, a.rs AS l_rs, b.rs AS r_rs FROM a FULL JOIN b ON a.method = b.method AND a.url = b.url AND a.nth = b.nth),
  j1 AS (SELECT j.*, {_HEADS('rq')} AS hq, {_HEADS('rs')} AS hs FROM j0 j),
  j2 AS (SELECT *, CASE WHEN la IS NULL THEN 'added' WHEN rb IS NULL THEN 'removed' WHEN left_status IS DISTINCT FROM right_status OR left_size IS DISTINCT FROM right_size OR coalesce(abs(lm - rm) > 1e-6, (lm IS NULL) <> (rm IS NULL)) OR coalesce(abs(lt - rt) > 1e-6, (lt IS NULL) <> (rt IS NULL)) OR hq > 0 OR hs > 0 THEN 'changed' END AS change FROM j1)"""

_KEY = ", ".join(store.MERGE_KEY)
_HASH = " || ".join(
    f"CASE WHEN {c} IS NULL THEN '~' ELSE strlen({t}) || ':' || {t} END"
    for c in store.HASHED
    for t in [f"(CASE WHEN isnan({c}) THEN 'nan' ELSE CAST(CAST(round({c} * 1000) AS DECIMAL(38,0)) AS VARCHAR) END)" if c in store._DOUBLES else f"CAST({c} AS VARCHAR)"]
)

_CACHE = "coalesce(response_headers::JSON->>'$.\"x-cache\"', response_headers::JSON->>'$.\"x-cache-status\"', response_headers::JSON->>'$.\"cf-cache-status\"')"
_ATTRIBUTES = [
    ("http.request.method", "upper(method)", "string"), ("url.full", "url", "string"), ("url.path", "path", "string"), ("url.query", "query_string", "string"), ("url.scheme", f"(CASE WHEN {_GOOD} THEN lower({_PART(1)}) END)", "string"), ("server.address", f"({_HOST})", "string"), ("server.port", f"TRY_CAST({_PORT} AS INTEGER)", "int"),
    ("http.response.status_code", "status", "int"), ("http.request.body.size", "(CASE WHEN request_body_size >= 0 THEN request_body_size END)", "int"), ("http.response.body.size", "(CASE WHEN response_body_size >= 0 THEN response_body_size END)", "int"), ("http.response.mime_type", "response_mime_type", "string"),
    ("network.peer.address", "server_ip", "string"), ("network.protocol.name", "lower(http_version)", "string"), ("http.connection_id", "connection_id", "string"), ("tls.protocol.version", "tls_version", "string"), ("tls.cipher", "tls_cipher_suite", "string"), ("page.id", "page_id", "string"),
    ("graphql.operation.type", "graphql_operation_type", "string"), ("graphql.operation.name", "graphql_operation_name", "string"), ("cache.status", _CACHE, "string"), ("cache.hit", f"contains(lower({_CACHE}), 'hit')", "bool"), ("cache.age", "TRY_CAST(trim(response_headers::JSON->>'$.age') AS BIGINT)", "int"),
]


def queries() -> dict[str, str]:
    pats = masking.PATTERNS
    found = lambda c: " UNION ALL ".join(f"SELECT id, '{k}' AS kind, len(regexp_extract_all({c}, '{p}')) AS n FROM x" for k, p in pats.items() if k != "credit_card")
    answers_key = "id, " + _PATH + " AS path, lower(method) AS method, status"
    return {
        "ordinal_diff": f"{_DIFF} SELECT change, method, url, nth, left_status, right_status, left_size, right_size, right_size - left_size AS size_delta, round(rm - lm, 6) AS ms_delta, round(rt - lt, 6) AS ttfb_delta FROM j2 WHERE change IS NOT NULL",
        "header_diff": f"{_DIFF} SELECT method, url, nth, hq AS request_header_changes, hs AS response_header_changes FROM j2 WHERE change = 'changed'",
        "merge_entries": f"""WITH u AS (SELECT *, row_number() OVER (ORDER BY import_id NOT IN {_DONE}, id) AS k FROM entries)
SELECT method, url, started_at, status, arg_min(id, k) AS id, count(*) AS copies, arg_min(tls_version, k) FILTER (WHERE tls_version IS NOT NULL) AS tls_version, arg_min(request_id, k) FILTER (WHERE request_id IS NOT NULL) AS request_id FROM u GROUP BY method, url, started_at, status""",
        "incremental_new": "SELECT arg_min(id, {'a': import_id, 'b': id}) AS id FROM entries WHERE entry_hash IS NOT NULL GROUP BY entry_hash UNION ALL SELECT id FROM entries WHERE entry_hash IS NULL",
        "new_entries": f"""WITH n AS (SELECT * FROM entries WHERE import_id NOT IN {_DONE} AND (entry_hash IS NULL OR entry_hash NOT IN (SELECT entry_hash FROM entries WHERE entry_hash IS NOT NULL AND import_id IN {_DONE})))
SELECT min(id) AS id FROM n WHERE entry_hash IS NOT NULL GROUP BY entry_hash UNION ALL SELECT id FROM n WHERE entry_hash IS NULL""",
        "strict_match": """WITH r AS (SELECT upper(method) AS m, url, id, status, row_number() OVER (PARTITION BY upper(method), url ORDER BY coalesce(started_at, '') DESC, id DESC) AS k FROM entries WHERE method IS NOT NULL AND url IS NOT NULL)
SELECT e.id, r.id AS recording_id, r.status AS recorded_status FROM entries e LEFT JOIN r ON r.m = upper(e.method) AND r.url = e.url AND r.k = 1""",
        "fuzzy_match": f"""WITH n AS (SELECT id, import_id, started_at, status, upper(method) AS m, lower({_PART(2)}) AS h, coalesce(TRY_CAST({_PORT} AS INTEGER), CASE WHEN lower({_PART(1)}) IN ('http', 'ws') THEN 80 WHEN lower({_PART(1)}) IN ('https', 'wss') THEN 443 END) AS port,
    coalesce(nullif(regexp_replace({_PATH}, '/+$', ''), ''), '/') AS p, [{{'n': url_decode(split_part(kv, '=', 1)), 'v': url_decode(replace(regexp_extract(kv, '=(.*)$', 1), '+', ' '))}} for kv in string_split({_QUERY}, '&') if kv <> ''] AS q FROM entries WHERE method IS NOT NULL AND url IS NOT NULL AND {_GOOD}),
  x AS (SELECT a.id, b.id AS recording_id, b.status, CAST(coalesce(len([k for k in a.q if list_contains(b.q, k)]), 0) AS BIGINT) AS score, b.started_at AS seen FROM n a JOIN n b ON a.m = b.m AND a.h = b.h AND a.port = b.port AND a.p = b.p AND a.import_id NOT IN {_DONE} AND b.import_id IN {_DONE}),
  best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, coalesce(seen, '') DESC, recording_id) AS k FROM x)
SELECT e.id, recording_id, best.status AS recorded_status, score FROM entries e LEFT JOIN best ON best.id = e.id AND k = 1 WHERE e.import_id NOT IN {_DONE}""",
        "search_bm25": _bm25(["manifest", "cookie"], _DOCS, "doc_id", "c0 > 0 AND c1 > 0"),
        "search_boolean": _bm25(["manifest", "cookie"], _DOCS, "doc_id", "(c0 > 0 OR c1 > 0) AND len(list_filter(t, lambda x: x = 'known')) = 0"),
        "search_phrase": _bm25(["known", "issue"], _DOCS, "doc_id", f"contains({_LINE}, ' known issue ')"),
        "search_near": _bm25(["known", "issue"], _DOCS, "doc_id", f"regexp_matches({_LINE}, ' known (?:[^ ]+ ){{0,3}}issue | issue (?:[^ ]+ ){{0,3}}known ')"),
        "search_prefix": f"WITH d AS ({_DOCS}), c AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: starts_with(x, 'normalis'))) AS k FROM d), s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (WHERE k > 0) AS d FROM c WHERE l > 0) SELECT doc_id, round(-(greatest(ln((n - d + 0.5) / (d + 0.5)), 1e-6) * k * 2.2 / (k + 1.2 * (0.25 + 0.75 * l / m))), 6) AS score FROM c, s WHERE k > 0",
        "search_postings": f"WITH d AS (SELECT doc_id, {_TOKENS('text')} AS t FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(t) AS token, unnest(range(len(t))) AS i FROM d) SELECT token, doc_id, count(*) AS tf, CAST(min(i) AS INTEGER) AS first_at FROM u GROUP BY 1, 2",
        "search_trigrams": "WITH d AS (SELECT item_id, lower(strip_accents(passage)) AS t FROM eval_items WHERE length(passage) >= 3), u AS (SELECT item_id, substr(t, CAST(unnest(range(1, length(t) - 1)) AS INTEGER), 3) AS token FROM d) SELECT token, item_id, count(*) AS tf FROM u GROUP BY 1, 2",
        "search_snippets": f"WITH d AS ({_DOCS}) SELECT doc_id, true AS marked FROM d WHERE list_contains(t, 'cookie')",
        "search_entries": f"SELECT e.id, e.started_at, e.url, e.status, h.score FROM entries e JOIN ({_bm25(['importer', 'viewport'], _BODIES, 'hash', 'c0 > 0 OR c1 > 0')}) h ON h.hash = e.response_body_hash",
        "mask_bodies": """WITH n AS (SELECT hash, regexp_replace(TRY(decode(content)), '[0-9]{4}', 'REDACTED', 'g') AS t, TRY(decode(content)) AS old FROM blobs), m AS (SELECT hash, t FROM n WHERE t <> old)
SELECT e.id, CASE WHEN m.hash IS NULL THEN e.response_body_hash ELSE sha256(m.t) END AS response_body_hash, CASE WHEN m.hash IS NULL THEN e.response_body_size ELSE strlen(m.t) END AS response_body_size, CASE WHEN m.hash IS NULL THEN e.response_body_hash_raw END AS response_body_hash_raw FROM entries e LEFT JOIN m ON m.hash = e.response_body_hash""",
        "pii_findings": f"""WITH b AS (SELECT hash, TRY(decode(content)) AS text FROM blobs), x AS (SELECT id, 1 AS location_no, url AS text FROM entries UNION ALL SELECT id, 2, text FROM entries JOIN b ON b.hash = request_body_hash UNION ALL SELECT id, 3, text FROM entries JOIN b ON b.hash = response_body_hash),
  y AS (SELECT id || ':' || location_no AS id, id AS e, location_no, text FROM x), r AS ({found('text').replace('FROM x', 'FROM y')} UNION ALL {_cards('y', 'id', 'text').replace("'credit_card' AS kind, count(*) AS n", "'credit_card' AS kind, count(*) AS n")})
SELECT CAST(split_part(id, ':', 1) AS BIGINT) AS id, ['url', 'request', 'response'][CAST(split_part(id, ':', 2) AS INTEGER)] AS location, kind, n, CAST(split_part(id, ':', 2) AS INTEGER) AS location_no, CAST(list_position({list(pats)}, kind) AS INTEGER) AS kind_no FROM r WHERE n > 0""",
        "merge_stats": f"""WITH i AS (SELECT source_file, imported_at, row_number() OVER (ORDER BY min(id)) AS n FROM imports GROUP BY 1, 2), m AS (SELECT imports.id, i.n FROM imports JOIN i ON i.source_file IS NOT DISTINCT FROM imports.source_file AND i.imported_at IS NOT DISTINCT FROM imports.imported_at),
  k AS (SELECT 'imports' AS table_name, 2 * (SELECT count(*) FROM imports) AS given, (SELECT count(*) FROM i) AS kept UNION ALL SELECT 'pages', 2 * (SELECT count(*) FROM pages), (SELECT count(*) FROM (SELECT DISTINCT p.id, m.n FROM pages p JOIN m ON m.id = p.import_id))
    UNION ALL SELECT 'entries', 2 * (SELECT count(*) FROM entries), (SELECT count(*) FROM (SELECT DISTINCT m.n, {_KEY} FROM entries e JOIN m ON m.id = e.import_id)) UNION ALL SELECT 'blobs', 2 * (SELECT count(*) FROM blobs), (SELECT count(DISTINCT hash) FROM blobs)
    UNION ALL SELECT 'graphql_fields', 2 * (SELECT count(*) FROM graphql_fields), (SELECT count(*) FROM (SELECT DISTINCT m.n, {_KEY}, g.field FROM entries e JOIN m ON m.id = e.import_id JOIN graphql_fields g ON g.entry_id = e.id)))
SELECT table_name, given, kept, given - kept AS repeats FROM k""",
        "trace_documents": f"""WITH {with_us(_ENTRIES)}, p AS ({_phases()})
SELECT id, 0 AS turn, left(sha256({_SEED} || '|request'), 16) AS span_id, us * 1000 AS start_ns FROM us WHERE us IS NOT NULL
UNION ALL SELECT us.id, 1, left(sha256({_SEED.replace('id', 'us.id')} || '|' || phase), 16), us * 1000 + CAST(round(a * 1000000) AS BIGINT) FROM us JOIN p ON p.id = us.id WHERE us IS NOT NULL AND b > a""",
        "capture_entries": f"""SELECT e.id, url, CAST(status AS VARCHAR) AS status, page_id AS page, CASE WHEN octet_length(b.content) > 0 THEN coalesce(TRY(decode(b.content)), base64(b.content)) END AS body, list_sort(json_keys(request_headers::JSON))[2] AS n_headers, entry_extensions::JSON->>'$._priority' AS priority,
  CASE WHEN coalesce({', '.join(_M(p + '_ms') for p in ('blocked', 'dns', 'connect', 'send', 'wait', 'receive', 'ssl'))}) IS NULL THEN coalesce({_M('time_ms')}, 0.0) ELSE coalesce({_M('wait_ms')}, 0.0) END AS wait FROM entries e LEFT JOIN blobs b ON b.hash = e.response_body_hash""",
        "catalog": "SELECT table_name, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name FROM information_schema.columns WHERE table_name IN ('imports', 'pages', 'entries', 'blobs', 'graphql_fields')",
        "span_attributes": " UNION ALL ".join(f"SELECT id, '{k}' AS key, CAST({v} AS VARCHAR) AS value, '{t}' AS kind FROM entries WHERE {v} IS NOT NULL" for k, v, t in _ATTRIBUTES),
        "store_info": f"""WITH s AS (SELECT (SELECT count(*) FROM entries) AS entries, (SELECT count(DISTINCT host) FROM entries) AS hosts, (SELECT count(*) FROM imports) AS imports, (SELECT CAST(coalesce(sum(entry_count), 0) AS BIGINT) FROM imports) + (SELECT count(*) FROM entries WHERE import_id IN (SELECT id FROM imports WHERE entry_count IS NULL)) AS counted,
    (SELECT count(*) FROM blobs) AS blobs, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM blobs) AS blob_bytes, (SELECT split_part(min(started_at), 'T', 1) FROM entries) AS first_date, (SELECT split_part(max(started_at), 'T', 1) FROM entries) AS last_date),
  c AS (SELECT count(*) AS entries, count(request_id) AS with_request_id, count(parent_request_id) AS with_parent, count(initiator_type) AS with_initiator, count(redirect_url) AS with_redirect FROM entries)
{' UNION ALL '.join(f"SELECT 'store' AS section, '{c}' AS name, CAST({c} AS VARCHAR) AS value FROM s" for c in ('entries', 'hosts', 'imports', 'counted', 'blobs', 'blob_bytes', 'first_date', 'last_date'))}
UNION ALL {' UNION ALL '.join(f"SELECT 'chains', '{c}', CAST({c} AS VARCHAR) FROM c" for c in ('entries', 'with_request_id', 'with_parent', 'with_initiator', 'with_redirect'))}
UNION ALL SELECT * FROM (SELECT 'hosts', host, CAST(count(*) AS VARCHAR) FROM entries WHERE host IS NOT NULL GROUP BY host ORDER BY count(*) DESC, host LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'initiators', initiator_type, CAST(count(*) AS VARCHAR) FROM entries WHERE initiator_type IS NOT NULL GROUP BY initiator_type ORDER BY count(*) DESC, initiator_type LIMIT 5)""",
        "mask_headers": "SELECT id, CASE WHEN request_headers::JSON->>'$.\"user-agent\"' IS NOT NULL THEN 'REDACTED' END AS user_agent, request_headers::JSON->>'$.accept' AS accept FROM entries",
        "mask_cookies": "SELECT id, CASE WHEN request_cookies::JSON->>'$[0].name' IS NOT NULL THEN 'REDACTED' END AS value, request_cookies::JSON->>'$[0].name' AS name FROM entries",
        "mask_params": _masked_url(),
        "mask_text": "SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[0-9]{3,}', '$X', 'g'), 'issue', '$X', 'g')) AS digest FROM documents",
        "redaction_report": """SELECT (SELECT count(*) FROM (SELECT unnest(json_keys(request_headers::JSON)) AS k FROM entries UNION ALL SELECT unnest(json_keys(response_headers::JSON)) FROM entries) WHERE lower(k) IN ('authorization', 'proxy-authorization', 'cookie', 'set-cookie', 'x-api-key', 'api-key', 'x-auth-token', 'x-csrf-token', 'csrf-token', 'x-xsrf-token')) AS headers,
  (SELECT CAST(sum(coalesce(json_array_length(request_cookies::JSON), 0) + coalesce(json_array_length(response_cookies::JSON), 0)) AS BIGINT) FROM entries) AS cookies,
  (SELECT count(*) FROM (SELECT unnest(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&')) AS kv FROM entries) WHERE lower(split_part(kv, '=', 1)) = 'ts') AS params,
  (SELECT coalesce(string_agg(DISTINCT k, ',' ORDER BY k), '') FROM (SELECT unnest(json_keys(request_headers::JSON)) AS k FROM entries UNION ALL SELECT unnest(json_keys(response_headers::JSON)) FROM entries) WHERE lower(k) IN ('authorization', 'proxy-authorization', 'cookie', 'set-cookie', 'x-api-key', 'api-key', 'x-auth-token', 'x-csrf-token', 'csrf-token', 'x-xsrf-token')) AS header_names,
  (SELECT coalesce(string_agg(DISTINCT k, ',' ORDER BY k), '') FROM (SELECT unnest(json_extract_string(request_cookies::JSON, '$[*].name')) AS k FROM entries UNION ALL SELECT unnest(json_extract_string(response_cookies::JSON, '$[*].name')) FROM entries)) AS cookie_names, 'ts' AS param_names""",
        "pattern_counts": "WITH x AS (SELECT doc_id AS id, text FROM documents), r AS (" + found("text") + ", luhn AS (SELECT 1)".replace(", luhn AS (SELECT 1)", "") + ") SELECT id AS doc_id, kind, n FROM r WHERE n > 0 UNION ALL " + _cards("documents", "doc_id", "text"),
        "valid_cards": f"SELECT doc_id, n FROM ({_cards('documents', 'doc_id', 'text')})",
        "slow_counts": f"SELECT count(*) FILTER (WHERE {_M('time_ms')} >= 1000) AS slow_total, count(*) FILTER (WHERE {_M('wait_ms')} >= 500) AS slow_ttfb FROM entries",
        "merge_fields": f"""WITH i AS (SELECT source_file, imported_at, row_number() OVER (ORDER BY min(id)) AS n FROM imports GROUP BY 1, 2), m AS (SELECT imports.id, i.n FROM imports JOIN i ON i.source_file IS NOT DISTINCT FROM imports.source_file AND i.imported_at IS NOT DISTINCT FROM imports.imported_at)
SELECT field, count(*) AS n FROM (SELECT DISTINCT m.n, {_KEY}, g.field FROM entries e JOIN m ON m.id = e.import_id JOIN graphql_fields g ON g.entry_id = e.id) GROUP BY 1""",
        "top_hosts": "SELECT host AS value, count(*) AS n FROM entries WHERE host IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 5",
        "certificates_within": "SELECT count(*) AS expiring, min(tls_cert_expiry) AS earliest FROM (SELECT DISTINCT tls_cert_subject, tls_cert_issuer, tls_cert_expiry FROM entries WHERE tls_cert_expiry <= '2026-04-01T00:00:00Z')",
        "certificates_first": "SELECT * FROM (SELECT DISTINCT host, tls_cert_subject, tls_cert_issuer, tls_cert_expiry, tls_version, tls_cipher_suite, tls_cert_expiry <= '2026-01-01' AS expired FROM entries WHERE tls_cert_expiry IS NOT NULL) ORDER BY tls_cert_expiry, host NULLS FIRST, tls_cert_subject NULLS FIRST, tls_cert_issuer NULLS FIRST, tls_version NULLS FIRST, tls_cipher_suite NULLS FIRST LIMIT 20",
        "error_top": "SELECT host, path, count(*) AS n, arg_min(url, id) AS sample_url FROM entries WHERE status >= 400 GROUP BY host, path ORDER BY n DESC, host NULLS FIRST, path NULLS FIRST LIMIT 10",
        "filter_hosts": "SELECT id, url, status FROM entries WHERE host IN ('www.tarn-shop.example', 'api.tarn-shop.example')",
        "filter_wildcards": "SELECT id, url, status FROM entries WHERE url ILIKE '%v_/%' OR url ILIKE '%items%%'",
        "filter_sources": "SELECT e.id, import_id FROM entries e JOIN imports i ON i.id = e.import_id WHERE source_file ILIKE '%.har.gz%'",
        "filter_import": f"WITH {with_us(_ENTRIES)} SELECT id, us AS start_us FROM us WHERE us IS NOT NULL AND upper(method) = 'POST' AND status IN (200, 404)",
        "filter_diff": "SELECT id FROM entries WHERE upper(method) = 'GET' AND status = 500 AND url <> '' AND regexp_matches(url, 'v2')",
        "filter_replay": "SELECT id FROM entries WHERE status = 200 AND url IS NOT NULL AND upper(method) IN ('GET', 'HEAD', 'OPTIONS', 'TRACE')",
        "filter_report": f"SELECT id FROM entries WHERE contains(url, 'items') AND {_EXT} IN ('js', 'css', 'png')",
        "filter_pages": "SELECT id, import_id FROM pages WHERE contains(lower(id), '1') OR contains(lower(title), '1')",
        "scan_first": "SELECT id, started_at, url FROM entries ORDER BY started_at NULLS FIRST, id LIMIT 100",
        "top_slowest": f"SELECT * FROM (SELECT id, method, url, status, started_at, {_M('time_ms')} AS ms FROM entries ORDER BY ms DESC NULLS LAST, started_at NULLS FIRST, id LIMIT 20) WHERE ms > 0",
        "waterfall": f"{_WATERFALL} SELECT group_no, row_no, id, offset_ms FROM w",
        "waterfall_groups": f"{_WATERFALL} SELECT group_no, group_name, count(*) AS n, min(offset_ms) AS from_ms FROM w GROUP BY 1, 2",
        "waterfall_none": f"WITH {with_us(_ENTRIES)} SELECT row_number() OVER (ORDER BY us, coalesce(url, '<unknown>'), id) AS row_no, id, 'All Requests' AS group_name, (us - min(us) OVER ()) // 1000 AS offset_ms FROM us WHERE us IS NOT NULL",
        "unreadable_starts": f"WITH {with_us(_ENTRIES)} SELECT count(*) - count(us) AS skipped FROM us",
        "trace_events": f"{_WATERFALL} SELECT DISTINCT group_no, CAST(0 AS BIGINT) AS turn, 'M' AS ph, CAST(NULL AS BIGINT) AS dur, CAST(NULL AS BIGINT) AS id FROM w UNION ALL SELECT group_no, row_no, 'X', CAST(round(coalesce({_M('time_ms')}, 0.0) * 1000) AS BIGINT), w.id FROM w JOIN entries e ON e.id = w.id",
        "phase_spans": f"WITH p AS ({_phases()}) SELECT p.id, left(sha256({_SEED.replace('id', 'e.id').replace('e.ide.id', 'id')}), 32) AS trace_id, left(sha256({_SEED} || '|request'), 16) AS parent_span_id, left(sha256({_SEED} || '|' || phase), 16) AS span_id, phase AS name, a AS start_ms, round(b - a, 6) AS duration_ms FROM p JOIN entries e USING (id) WHERE b > a".replace("e.id", "id").replace("p.id", "id"),
        "spans": f"""WITH l AS (SELECT id, max(b) AS last_ms FROM ({_phases()}) GROUP BY id)
SELECT e.id, left(sha256({_SEED}), 32) AS trace_id, left(sha256({_SEED} || '|request'), 16) AS span_id, concat_ws(' ', upper(method), coalesce(path, '/')) AS name, CASE WHEN status >= 400 THEN 'Error' WHEN status IS NOT NULL THEN 'Ok' ELSE 'Unset' END AS status_code, coalesce({_M('time_ms')}, last_ms, 0.0) AS duration_ms FROM entries e LEFT JOIN l USING (id)""".replace("e.id,", "id,"),
        "api_operations": f"""WITH r AS (SELECT {answers_key}, CASE WHEN request_body_size > 0 THEN {_TYPE("request_headers::JSON->>'$.\"content-type\"'")} END AS sent, coalesce({_TYPE('response_mime_type')}, {_TYPE("response_headers::JSON->>'$.\"content-type\"'")}) AS mime, {_SERVER} AS server, {_QUERY} AS q FROM entries),
  k AS (SELECT * FROM r WHERE path IS NOT NULL AND method IS NOT NULL), u AS (SELECT path, method, unnest(string_split(q, '&')) AS kv FROM k), n AS (SELECT path, method, {_decoded("split_part(kv, '=', 1)")} AS name FROM u),
  m AS (SELECT path, method, string_agg(DISTINCT name, ',' ORDER BY name) AS query_names FROM n WHERE name <> '' GROUP BY 1, 2)
SELECT path, method, coalesce(string_agg(DISTINCT sent, ',' ORDER BY sent), '') AS request_types, coalesce(string_agg(DISTINCT CAST(status AS VARCHAR), ',' ORDER BY CAST(status AS VARCHAR)), '') AS statuses, coalesce(string_agg(DISTINCT mime, ',' ORDER BY mime), '') AS response_types, coalesce(string_agg(DISTINCT server, ',' ORDER BY server), '') AS servers, count(*) AS n, any_value(query_names) AS query_names
FROM k LEFT JOIN m USING (path, method) GROUP BY path, method""",
        "api_answers": f"""WITH r AS (SELECT {answers_key}, coalesce({_TYPE('response_mime_type')}, {_TYPE("response_headers::JSON->>'$.\"content-type\"'")}) AS mime FROM entries)
SELECT path, method, status, coalesce(string_agg(DISTINCT mime, ',' ORDER BY mime), '') AS response_types, count(*) AS n FROM r WHERE path IS NOT NULL AND method IS NOT NULL GROUP BY 1, 2, 3""",
        "capture_pages": "SELECT import_id, id, import_id || ':' || id AS ident, coalesce(title, '') AS title FROM pages",
        "pages_for_imports": f"SELECT id, import_id, title FROM pages WHERE import_id IN {_OPEN}",
        "blobs_by_hash": "SELECT hash, size FROM blobs WHERE hash IN (SELECT response_body_hash FROM entries WHERE status >= 500)",
        "insert_pages": f"SELECT id, import_id, arg_min(title, {{'a': coalesce(started_at, ''), 'b': coalesce(title, '')}}) AS title FROM pages WHERE import_id NOT IN {_OPEN} GROUP BY 1, 2",
        "external_blobs": "SELECT hash, size, mime_type, 'bodies/' || hash AS external_path, octet_length(content) AS held FROM blobs WHERE hash IS NOT NULL",
        "unpacked_bodies": "SELECT e.id, CAST(octet_length(p.content) AS BIGINT) AS size FROM entries e JOIN blobs r ON r.hash = e.response_body_hash_raw LEFT JOIN blobs p ON p.hash = e.response_body_hash",
        "hash_backfill": f"SELECT id, sha256('v1' || {_HASH}) AS v1, coalesce(entry_hash, sha256('v1' || {_HASH})) AS entry_hash FROM entries",
        "resume_points": "WITH n AS (SELECT source_file, max(id) AS import_id FROM imports WHERE status <> 'complete' OR status IS NULL GROUP BY 1) SELECT source_file, import_id, (SELECT count(*) FROM entries e WHERE e.import_id = n.import_id) AS stored FROM n",
        "recount_imports": "SELECT i.id, count(e.id) AS entry_count FROM imports i LEFT JOIN entries e ON e.import_id = i.id GROUP BY i.id",
        "prune_entries": f"SELECT id FROM entries WHERE import_id NOT IN {_OPEN} OR import_id IS NULL",
        "prune_blobs": f"WITH gone AS (SELECT * FROM entries WHERE import_id IN {_OPEN}), left_ AS (SELECT * FROM entries WHERE import_id NOT IN {_OPEN} OR import_id IS NULL), dead AS ({_USED.format('gone')} EXCEPT ({_USED.format('left_')})) SELECT hash FROM blobs WHERE hash NOT IN (SELECT hash FROM dead)",
        "prune_fields": f"SELECT entry_id, field FROM graphql_fields WHERE entry_id NOT IN (SELECT id FROM entries WHERE import_id IN {_OPEN})",
        "merge_store": f"""WITH i AS (SELECT source_file, imported_at, row_number() OVER (ORDER BY min(id)) AS n FROM imports GROUP BY 1, 2), m AS (SELECT imports.id, i.n FROM imports JOIN i ON i.source_file IS NOT DISTINCT FROM imports.source_file AND i.imported_at IS NOT DISTINCT FROM imports.imported_at),
  k AS (SELECT m.n AS new_import, {_KEY}, max(CASE WHEN tls_version IS NOT NULL THEN 1 ELSE 0 END) AS tls FROM entries e JOIN m ON m.id = e.import_id GROUP BY ALL)
SELECT new_import AS import_id, count(*) AS n, CAST(sum(tls) AS BIGINT) AS with_tls FROM k GROUP BY 1""",
        "conformed": "SELECT id, CAST(NULL AS VARCHAR) AS tls_version, CAST(NULL AS BIGINT) AS initiator_line, url FROM entries",
        "capture_roundtrip": f"""SELECT e.id, method, url, CASE WHEN {_GOOD} THEN lower({_PART(2)}) END AS host, {_PATH} AS path, {_QUERY} AS query_string, status, CASE WHEN status IS NULL THEN NULL WHEN status BETWEEN 300 AND 399 THEN 1 ELSE 0 END AS is_redirect, started_at, page_id,
  {_M('dns_ms')} AS dns_ms, connection_id, lower(request_headers)::JSON->>'$."user-agent"' AS agent, CASE WHEN octet_length(b.content) > 0 THEN sha256(b.content) END AS body FROM entries e LEFT JOIN blobs b ON b.hash = e.response_body_hash""",
        "form_pairs": f"WITH s AS (SELECT id, list_filter(string_split(query_string, '&'), lambda x: x <> '') AS kv FROM entries WHERE query_string IS NOT NULL), u AS (SELECT id, CAST(unnest(range(len(kv))) AS INTEGER) AS no, unnest(kv) AS kv FROM s) SELECT id, no, {_decoded("split_part(kv, '=', 1)")} AS name, {_decoded("replace(regexp_extract(kv, '=(.*)$', 1), '+', ' ')")} AS value FROM u",
        "entries_after_filter_plugin": "SELECT id FROM entries WHERE status = 404",
        "text_bodies": "SELECT hash, coalesce(regexp_matches(lower(mime_type), 'text/|json|xml|javascript|css|html|x-www-form-urlencoded'), false) AS text, octet_length(content) BETWEEN 1 AND 1000 AND TRY(decode(content)) IS NOT NULL AND (mime_type IS NULL OR regexp_matches(lower(mime_type), 'text/|json|xml|javascript|css|html|x-www-form-urlencoded')) AS indexable, coalesce(octet_length(content) BETWEEN 1 AND 500 AND regexp_matches(lower(mime_type), 'text/|json|xml|javascript|css|html|x-www-form-urlencoded'), false) AS kept FROM blobs",
        "sql_like": "SELECT id FROM entries WHERE url ILIKE '%/items/%' AND regexp_matches(path, '(?s)^/.*/v2.*$')",
        "sql_listagg": "SELECT import_id, string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM entries GROUP BY import_id",
        "sql_recursive": "WITH RECURSIVE n(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM n WHERE k < 20) SELECT k, (SELECT count(*) FROM entries WHERE import_id = k) AS n FROM n",
        "sql_frames": "SELECT id, CAST(sum(status) OVER (PARTITION BY import_id ORDER BY id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s, lag(id) OVER (PARTITION BY import_id ORDER BY id) AS before, CAST(dense_rank() OVER (PARTITION BY import_id ORDER BY status NULLS FIRST) AS INTEGER) AS r FROM entries",
        "sql_outer": "SELECT e.id, p.title FROM (SELECT * FROM entries WHERE status = 500) e FULL OUTER JOIN pages p ON p.id = e.page_id AND p.import_id = e.import_id",
        "blob_savings": "WITH b AS (SELECT 'request' AS side, request_body_hash AS hash, request_body_size AS size FROM entries UNION ALL SELECT 'response', response_body_hash, response_body_size FROM entries), p AS (SELECT side, hash, count(*) AS n, max(size) AS size FROM b WHERE hash IS NOT NULL GROUP BY 1, 2) SELECT side, count(*) AS unique_bodies, CAST(sum(coalesce(size, 0)) AS BIGINT) AS unique_bytes, CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum((n - 1) * coalesce(size, 0)) AS BIGINT) AS bytes_saved FROM p GROUP BY 1",
        "filter_sample": "SELECT id FROM entries WHERE left(sha256(coalesce(entry_hash, '') || coalesce(url, '') || coalesce(started_at, '')), 16) <= '4000000000000000'",
        "store_stats": """SELECT (SELECT count(*) FROM entries) AS entries, (SELECT min(started_at) FROM entries) AS first_at, (SELECT max(started_at) FROM entries) AS last_at, (SELECT count(DISTINCT host) FROM entries) AS hosts,
  (SELECT count(*) FROM imports) AS imports, (SELECT CAST(coalesce(sum(entry_count), 0) AS BIGINT) FROM imports) + (SELECT count(*) FROM entries WHERE import_id IN (SELECT id FROM imports WHERE entry_count IS NULL)) AS counted, (SELECT count(*) FROM blobs) AS blobs, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM blobs) AS blob_bytes""",
    }


def _cards(table: str, key: str, text: str) -> str:
    """Valid cards per row, the check digit worked out digit by digit."""
    bare = "regexp_replace(m, '[^0-9]', '', 'g')"
    return f"""SELECT {key}, 'credit_card' AS kind, count(*) AS n FROM (SELECT {key}, {bare} AS d FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{masking.PATTERNS['credit_card']}')) AS m FROM {table}))
WHERE length(d) BETWEEN 13 AND 19 AND list_sum([CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INTEGER) ELSE (CAST(d[i] AS INTEGER) * 2) // 10 + (CAST(d[i] AS INTEGER) * 2) % 10 END for i in range(1, length(d) + 1)]) % 10 = 0 GROUP BY {key}"""
