"""SQL that places requests in their trees by plain recursion, to compare with."""

from __future__ import annotations

_REST = "regexp_extract(t, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$', 1)"
_NET = "lower(regexp_extract(t, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1))"
_DOTS = "x"
for _ in range(4):
    _DOTS = rf"regexp_replace({_DOTS}, '/[^/?#]+/\.\./', '/')"

#: Links of requests to their parents: ``import_id``, ``v``, ``p``.
LINKS = f"""e AS (SELECT id, import_id, request_id, parent_request_id, status, url, redirect_url FROM entries WHERE request_id IS NOT NULL),
  f AS (SELECT import_id, request_id, arg_min({{'p': parent_request_id, 'url': url}}, id) AS x FROM e GROUP BY 1, 2),
  r1 AS (SELECT id, import_id, request_id, url AS base, trim(redirect_url) AS t FROM e WHERE status BETWEEN 300 AND 399 AND redirect_url IS NOT NULL AND url IS NOT NULL AND trim(redirect_url) <> ''),
  r2 AS (SELECT *, regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*:)//', 1) AS scheme, regexp_extract(base, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_extract(base, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path FROM r1),
  r3 AS (SELECT id, import_id, request_id, CASE WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN t WHEN starts_with(t, '//') THEN scheme || t WHEN starts_with(t, '/') THEN origin || t
    WHEN starts_with(t, '?') THEN origin || path || t ELSE origin || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || t END AS t FROM r2),
  r4 AS (SELECT id, import_id, request_id, regexp_replace(regexp_replace({_NET}, '^(https?://.*)$', '\\1'), '^(http://[^:]*):80$|^(https://[^:]*):443$', '\\1\\2') AS net, {_REST} AS x FROM r3),
  r AS (SELECT import_id, net || {_DOTS} AS url, arg_min(request_id, id) AS via FROM r4 GROUP BY 1, 2),
  k AS (SELECT f.import_id, f.request_id AS v, CASE WHEN f.x.p IS NULL THEN r.via ELSE f.x.p END AS q FROM f LEFT JOIN r ON r.import_id = f.import_id AND r.url = f.x.url AND f.x.p IS NULL),
  l AS (SELECT a.import_id, a.v, b.v AS p FROM k a LEFT JOIN k b ON b.import_id = a.import_id AND b.v = a.q),
  up AS (SELECT import_id, v, v AS a FROM l UNION SELECT up.import_id, up.v, l.p FROM up JOIN l ON l.import_id = up.import_id AND l.v = up.a WHERE l.p IS NOT NULL),
  far AS (SELECT up.import_id, up.v, l.p AS a FROM up JOIN l ON l.import_id = up.import_id AND l.v = up.a WHERE l.p IS NOT NULL),
  ring AS (SELECT DISTINCT import_id, v FROM far WHERE v = a),
  tops AS (SELECT up.import_id, up.v, max(CASE WHEN l.p IS NULL THEN up.a END) AS top, min(CASE WHEN ring.v IS NOT NULL THEN up.a END) AS low
    FROM up JOIN l ON l.import_id = up.import_id AND l.v = up.a LEFT JOIN ring ON ring.import_id = up.import_id AND ring.v = up.a GROUP BY 1, 2)"""

FOUND = f"WITH RECURSIVE {LINKS} SELECT l.import_id, l.v AS request_id, coalesce(top, low) AS root_request_id FROM l JOIN tops USING (import_id, v) WHERE l.p IS NOT NULL"
DESCENDANTS = f"WITH RECURSIVE {LINKS} SELECT import_id, far.a AS ancestor, v AS descendant FROM (SELECT DISTINCT * FROM far) far JOIN tops USING (import_id, v) WHERE top IS NOT NULL"
HIERARCHY = f"""WITH RECURSIVE {LINKS},
  way AS (SELECT import_id, v, [v] AS path FROM l WHERE p IS NULL UNION ALL SELECT l.import_id, l.v, list_append(way.path, l.v) FROM way JOIN l ON l.import_id = way.import_id AND l.p = way.v),
  size AS (SELECT import_id, a AS v, count(*) AS n FROM up GROUP BY 1, 2),
  tree AS (SELECT way.*, size.n, row_number() OVER (PARTITION BY import_id ORDER BY path) - 1 AS no FROM way JOIN size USING (import_id, v)),
  steps AS (SELECT import_id, v, 0 AS d FROM ring UNION ALL SELECT l.import_id, l.v, steps.d + 1 FROM steps JOIN l ON l.import_id = steps.import_id AND l.p = steps.v LEFT JOIN ring ON ring.import_id = l.import_id AND ring.v = l.v WHERE ring.v IS NULL)
SELECT l.import_id, l.v AS request_id, l.p AS parent_request_id, coalesce(tops.top, tops.low) AS root, coalesce(len(tree.path) - 1, steps.d) AS depth, tree.n AS subtree_size, tree.no AS first_no, tree.no + tree.n - 1 AS last_no,
  array_to_string(tree.path, '/') AS path, CASE WHEN tree.v IS NOT NULL THEN 'tree' WHEN steps.d = 0 THEN 'loop' ELSE 'below' END AS on_loop
FROM l JOIN tops USING (import_id, v) LEFT JOIN tree USING (import_id, v) LEFT JOIN steps ON steps.import_id = l.import_id AND steps.v = l.v"""
