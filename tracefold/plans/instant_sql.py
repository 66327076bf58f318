"""SQL that reads recorded times and what builds on them, to compare with."""

from __future__ import annotations

_ZONE = r"(?: *(Z|UTC|GMT|CET|CEST|EST|EDT|JST|[+-]\d{2}(?::?\d{2})?))?(?: *\[[^\]]*\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
# a pattern and the groups of year, month, day, hour, minute, second, fraction, half, zone
_FORMS = [
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}})(?:(?:T| +){_CLOCK}{_ZONE})?$", r"\1|\2|\3|\4|\5|\6|\7||\8"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d+))?)?{_ZONE}$", r"\1|\2|\3|\4|\5|\6|\7||\8"),
    (rf"^(?:[a-z]{{3,9}},? +)?(\d{{1,2}})[ -]([a-z]{{3}})[a-z]*[ -](\d{{4}}) +{_CLOCK}{_ZONE}$", r"\3|\2|\1|\4|\5|\6|\7||\8"),
    (rf"^(\d{{1,2}})/([a-z]{{3}})/(\d{{4}}):{_CLOCK}{_ZONE}$", r"\3|\2|\1|\4|\5|\6|\7||\8"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:(?:,? +|T){_CLOCK}{_ZONE})?$", r"\3|\2|\1|\4|\5|\6|\7||\8"),
    (rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? +{_CLOCK}(?: *(AM|PM))?{_ZONE})?$", r"\3|\1|\2|\4|\5|\6|\7|\8|\9"),
]
_PARTS = " ".join(f"WHEN regexp_matches(x_, '{p}', 'i') THEN regexp_replace(x_, '{p}', '{r}', 'i')" for p, r in _FORMS)
_INT = lambda k: f"CASE WHEN p_[{k}] = '' THEN 0 ELSE TRY_CAST(p_[{k}] AS INTEGER) END"


def with_us(rows: str) -> str:
    """CTEs that end in ``us``: the rows of a SELECT with columns ``raw`` and ``zone`` and their instants ``us``."""
    return f"""r0_ AS ({rows}),
  r1_ AS (SELECT *, regexp_replace(raw, '^[\\s\\x{{00a0}}\\x{{feff}}]+|[\\s\\x{{00a0}}\\x{{feff}}]+$', '', 'g') AS x_ FROM r0_),
  r2_ AS (SELECT *, string_split(CASE {_PARTS} END, '|') AS p_, CASE WHEN regexp_matches(x_, '^[0-9]{{1,19}}(\\.[0-9]+)?$') THEN x_ END AS n_ FROM r1_),
  r3_ AS (SELECT *, {_INT(1)} AS y_, CASE WHEN regexp_matches(p_[2], '^[0-9]') THEN {_INT(2)} ELSE list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(p_[2])) END AS m_,
    {_INT(3)} AS d_, {_INT(4)} AS h_, {_INT(5)} AS mi_, {_INT(6)} AS s_, left(rpad(p_[7], 6, '0'), 6) AS f_, upper(p_[8]) AS half_, replace(upper(p_[9]), ':', '') AS z_,
    TRY_CAST(regexp_extract(n_, '^[0-9]+') AS HUGEINT) AS w_, length(ltrim(regexp_extract(n_, '^[0-9]+'), '0')) AS l_, rpad(regexp_extract(n_, '\\.([0-9]+)$', 1), 6, '0') AS nf_ FROM r2_),
  r4_ AS (SELECT *, CASE WHEN y_ >= 1 AND h_ <= 23 AND mi_ <= 59 AND s_ <= 59 AND (half_ = '' OR h_ BETWEEN 1 AND 12)
    THEN TRY_CAST(printf('%04d-%02d-%02d %02d:%02d:%02d.%s', y_, m_, d_, CASE WHEN half_ = '' THEN h_ ELSE h_ % 12 + CASE WHEN half_ = 'PM' THEN 12 ELSE 0 END END, mi_, s_, f_) AS TIMESTAMP) END AS wall_,
    CASE WHEN regexp_matches(z_, '^[A-Z]') THEN MAP {{'Z': 0, 'UTC': 0, 'GMT': 0, 'CET': 60, 'CEST': 120, 'EST': -300, 'EDT': -240, 'JST': 540}}[z_]
      WHEN TRY_CAST(z_[2:3] AS INTEGER) <= 23 AND coalesce(TRY_CAST(nullif(z_[4:5], '') AS INTEGER), 0) <= 59 THEN (TRY_CAST(z_[2:3] AS INTEGER) * 60 + coalesce(TRY_CAST(nullif(z_[4:5], '') AS INTEGER), 0)) * CASE WHEN z_[1] = '-' THEN -1 ELSE 1 END END AS off_,
    CASE WHEN zone IN (SELECT name FROM pg_timezone_names()) THEN zone ELSE 'UTC' END AS tz_ FROM r3_),
  r5_ AS (SELECT *, timezone(tz_, wall_) AS late_ FROM r4_),
  us AS (SELECT * EXCLUDE (x_, p_, n_, y_, m_, d_, h_, mi_, s_, f_, half_, z_, w_, l_, nf_, wall_, off_, tz_, late_), CAST(CASE
    WHEN n_ IS NOT NULL THEN CASE WHEN l_ <= 11 THEN w_ * 1000000 + CAST(left(nf_, 6) AS BIGINT) WHEN l_ <= 14 THEN w_ * 1000 + CAST(left(nf_, 3) AS BIGINT) WHEN l_ <= 17 THEN w_ ELSE w_ // 1000 END
    WHEN z_ <> '' THEN epoch_us(wall_) - off_ * CAST(60000000 AS BIGINT)
    WHEN timezone(tz_, late_ - INTERVAL 1 HOUR) = wall_ THEN epoch_us(late_ - INTERVAL 1 HOUR) ELSE epoch_us(late_) END AS BIGINT) AS us FROM r5_)"""


_ZONES = "LEFT JOIN (SELECT id AS zi, log_extensions::JSON->>'$._timeZone' AS zone FROM imports) z ON z.zi = e.import_id"
_STARTS = f"""SELECT 'entries' AS table_name, e.import_id, CAST(e.id AS VARCHAR) AS row_key, e.started_at AS raw, zone FROM entries e {_ZONES}
    UNION ALL SELECT 'pages', e.import_id, e.id, e.started_at, zone FROM pages e {_ZONES}"""
_ENTRIES = f"SELECT e.*, e.started_at AS raw, zone FROM entries e {_ZONES}"

FOUND = f"WITH {with_us(_STARTS)} SELECT table_name, import_id, row_key, us AS utc_us FROM us WHERE us IS NOT NULL AND NOT regexp_matches(raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}\\.[0-9]{{3}}Z$')"
NORMALISED = f"WITH {with_us(_STARTS)} SELECT table_name, import_id, row_key, raw, us AS utc_us FROM us"

_BUSY = f"""WITH {with_us(_ENTRIES)},
  iv AS (SELECT 'connection' AS entity_kind, import_id, connection_id AS entity_id, id, us AS a, us + CAST(round(least(time_ms * 1000.0, 2e18)) AS BIGINT) AS b FROM us WHERE us BETWEEN -2000000000000000000 AND 2000000000000000000 AND time_ms >= 0 AND NOT isnan(time_ms) AND connection_id IS NOT NULL
    UNION ALL SELECT 'page', import_id, page_id, id, us, us + CAST(round(least(time_ms * 1000.0, 2e18)) AS BIGINT) FROM us WHERE us BETWEEN -2000000000000000000 AND 2000000000000000000 AND time_ms >= 0 AND NOT isnan(time_ms) AND page_id IS NOT NULL),
  c AS (SELECT *, max(b) OVER (PARTITION BY entity_kind, import_id, entity_id ORDER BY a, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM iv)"""
GAPS = f"{_BUSY} SELECT entity_kind, import_id, entity_id, id AS next_entry_id FROM c WHERE a > top"
PERIODS = f"""{_BUSY}, n AS (SELECT *, sum(CASE WHEN top IS NULL OR a > top THEN 1 ELSE 0 END) OVER (PARTITION BY entity_kind, import_id, entity_id ORDER BY a, id) AS k FROM c)
SELECT entity_kind, import_id, entity_id, min(a) AS busy_from_us, max(b) AS busy_to_us, count(*) AS n_entries FROM n GROUP BY entity_kind, import_id, entity_id, k"""

OFFSETS = f"WITH {with_us(_ENTRIES)} SELECT id, import_id, (us - min(us) OVER (PARTITION BY import_id)) // 1000 AS offset_ms FROM us WHERE us IS NOT NULL"
TIME_RANGE = f"WITH {with_us(_ENTRIES)} SELECT min(us) AS first_us, max(us) AS last_us, max(us + CASE WHEN NOT isnan(time_ms) AND time_ms >= 0 AND time_ms < 1e12 THEN CAST(round(time_ms * 1000) AS BIGINT) ELSE 0 END) AS end_us FROM us WHERE us IS NOT NULL"
SESSIONS = f"""WITH {with_us(_ENTRIES)}, t AS (SELECT id, import_id, us, coalesce(url, '<unknown>') AS url, CASE WHEN upper(method) = 'GET' AND regexp_matches(lower(coalesce(response_mime_type, '')), 'text/html|application/xhtml\\+xml') THEN 1 ELSE 0 END AS nav FROM us WHERE page_id IS NULL AND us IS NOT NULL),
  k AS (SELECT *, row_number() OVER (PARTITION BY import_id ORDER BY us, url, id) AS k FROM t)
SELECT id, import_id, CAST(sum(CASE WHEN k = 1 THEN 1 ELSE nav END) OVER (PARTITION BY import_id ORDER BY k) AS BIGINT) AS session FROM k"""
