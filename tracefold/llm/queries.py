"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracefold.llm import leaks, packing, percentiles, pii, repeats, splitting


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": repeats.p2_found,
        "p2_batches": repeats.p2_batches,
        "p5_found": percentiles.p5_found,
        "p5_percentiles": percentiles.p5_percentiles,
        "p5_merged": percentiles.p5_merged,
        "p6_found": pii.p6_found,
        "p6_masked": pii.p6_masked,
        "p8_containers": packing.p8_containers,
        "p9_found": leaks.p9_found,
        "p9_cleaned": leaks.p9_cleaned,
        "p10_pieces": splitting.p10_pieces,
    }


_HOSTS = "nullif(regexp_replace(lower(host), '\\.$', ''), '')"
_VALUES = f"""
  v AS (SELECT {_HOSTS} AS host, unnest(['time_ms', 'wait_ms']) AS metric, unnest([time_ms, wait_ms]) AS value FROM entries),
  m AS (SELECT * FROM v WHERE host IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND value >= 0)"""


_CLEAN = lambda c: rf"""lower(nfc_normalize(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '\\\\u[0-9a-fA-F]{{4}}|\\\\[nrtbf"/\\\\]', ' ', 'g'), '&(?:nbsp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);', ' ', 'g'), '&amp;', '&', 'g'), '<[/!]?[A-Za-z!-][^<>]*>', ' ', 'g'), '\]\([^()\s]*\)', ' ', 'g')))"""
_WORDS = lambda c: rf"list_filter(regexp_split_to_array({_CLEAN(c)}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_SHINGLES = lambda key, c, t: f"SELECT DISTINCT {key}, hash(array_to_string(w[i:i+11], ' ')) AS h FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS i FROM (SELECT {key}, {_WORDS(c)} AS w FROM {t} WHERE {c} IS NOT NULL) WHERE len(w) >= 12)"
#: Passages of twelve words by their shingles; escapes and entities are taken for blanks here.
_LEAKED = f"SELECT DISTINCT item_id, doc_id FROM ({_SHINGLES('item_id', 'passage', 'eval_items')}) i JOIN ({_SHINGLES('doc_id', 'text', 'documents')}) d USING (h)"

_EXACT = f"""WITH {_VALUES},
  o AS (SELECT *, row_number() OVER (PARTITION BY host, metric ORDER BY value) AS r, count(*) OVER (PARTITION BY host, metric) AS n FROM m),
  x AS (SELECT host, metric, n, max(value) FILTER (WHERE r = (n + 1) // 2) AS p50, max(value) FILTER (WHERE r = (9 * n + 9) // 10) AS p90,
  max(value) FILTER (WHERE r = (95 * n + 99) // 100) AS p95, max(value) FILTER (WHERE r = (99 * n + 99) // 100) AS p99 FROM o GROUP BY host, metric, n)"""
_STEP = f"ln(CAST(1 AS DOUBLE) + CAST({2 * percentiles.GRID_ERROR / (1 - percentiles.GRID_ERROR)!r} AS DOUBLE))"
_GRID = lambda q: f"round(CASE WHEN {q} = 0 OR isinf({q}) THEN {q} ELSE exp(floor(ln({q}) / {_STEP}) * {_STEP}) * CAST({1 + percentiles.GRID_ERROR / (1 - percentiles.GRID_ERROR)!r} AS DOUBLE) END, 6) AS {q}"


def oracle_sql() -> dict[str, str]:
    return {
        "p9_found": _LEAKED,
        "p5_found": f"""WITH {_VALUES},
  h AS (SELECT {_HOSTS} AS host FROM entries GROUP BY 1 HAVING count(*) * 40 >= (SELECT count(*) FROM entries))
SELECT host, metric FROM m WHERE host IN (SELECT host FROM h) GROUP BY host, metric
HAVING quantile_disc(value, 0.9) > 5 * quantile_disc(value, 0.5)""",
        "p5_percentiles": f"{_EXACT} SELECT * FROM x",
        "p5_merged": f"{_EXACT} SELECT host, metric, n, {', '.join(_GRID(q) for q in ('p50', 'p90', 'p95', 'p99'))} FROM x",
    }
