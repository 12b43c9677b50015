"""Oracle SQL: joins along time, sessions, subtotals, sketches, ranks and change history."""

from __future__ import annotations

from oracle import discsql as D
from oracle import storesql as S

Q: dict[str, str] = {}

_MICROS = "'%Y-%m-%d %H:%M:%S.%f'"


def _moved(t: str) -> str:
    return f"TIMESTAMP '2024-01-01' + to_seconds(CAST(floor(date_diff('second', TIMESTAMP '1995-01-01', {t}) / 81) AS BIGINT))"


_ORDERS = f"o AS (SELECT o_orderkey, o_custkey AS user_id, o_totalprice, {_moved('o_orderdate')} AS placed_at FROM orders)"

Q["asof_join"] = f"""WITH {_ORDERS},
j AS (SELECT event_id, e.user_id, o_orderkey, o_totalprice, placed_at,
        row_number() OVER (PARTITION BY event_id ORDER BY placed_at DESC NULLS LAST, o_orderkey DESC) AS n
      FROM events e LEFT JOIN o ON o.user_id = e.user_id AND o.placed_at <= e.ts)
SELECT event_id, user_id, o_orderkey, o_totalprice, {S.tstr('placed_at')} AS placed_at FROM j WHERE n = 1"""

Q["last_touch"] = f"""
SELECT p.event_id, p.user_id, p.value, c.event_id AS click_id, strftime(c.ts, {_MICROS}) AS clicked_at FROM (
  SELECT p.event_id, max(c.ts) AS at FROM events p LEFT JOIN events c
    ON c.user_id = p.user_id AND c.event_type = 'click' AND c.ts < p.ts WHERE p.event_type = 'purchase' GROUP BY 1) m
JOIN events p ON p.event_id = m.event_id
LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) c ON c.user_id = p.user_id AND c.ts = m.at"""

Q["interval_join"] = f"""WITH {_ORDERS},
s AS (SELECT l_orderkey, {_moved('max(l_shipdate)')} AS closed_at FROM lineitem GROUP BY 1)
SELECT o_orderkey, event_id, e.user_id FROM o JOIN s ON o_orderkey = l_orderkey JOIN events e ON e.user_id = o.user_id AND e.ts BETWEEN placed_at AND closed_at"""

Q["session_windows"] = f"""WITH g AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, strftime(min(ts), {_MICROS}) AS session_start, strftime(max(ts) + INTERVAL 6 HOURS, {_MICROS}) AS session_end,
  count(*) AS n_events, round(sum(value), 4) AS total, min(event_id) AS first_event FROM n GROUP BY user_id, session"""
Q["stream_sessions"] = Q["session_windows"]

Q["follow_ups"] = f"""
SELECT DISTINCT user_id, strftime(ts, {_MICROS}) AS opened_at, strftime(ts + INTERVAL 48 HOURS, {_MICROS}) AS due_at
FROM events o WHERE event_type = 'signup' AND NOT EXISTS (
  SELECT 1 FROM events c WHERE c.user_id = o.user_id AND c.event_type = 'purchase' AND c.ts > o.ts AND c.ts <= o.ts + INTERVAL 48 HOURS)"""
Q["stream_follow_ups"] = Q["follow_ups"]

_SUMS = """count(*) AS leads, count(*) FILTER (has_email) AS with_email, count(*) FILTER (score >= 70) AS hot,
  round(sum(score) / count(score), 6) AS avg_score"""


def _dims(dims: list[str]) -> str:
    return ", ".join([*dims, f"CAST(grouping({', '.join(dims)}) AS BIGINT) AS grouping_id", *[f"grouping({d}) = 1 AS {d}_is_total" for d in dims]])


Q["lead_funnel"] = f"""{S.W}, g AS (
  SELECT l.*, CASE WHEN r_regionkey = 1 THEN 'United States' ELSE r_name END AS country, n_name AS state,
    CASE WHEN c_custkey % 11 <> 0 THEN 'City ' || c_custkey % 5 END AS city
  FROM fx_leads l JOIN customer ON l.id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT {_dims(['country', 'state', 'city', 'status'])}, {_SUMS} FROM g
GROUP BY GROUPING SETS ((country, state, city, status), (country, state, city), (country, state, status), (country, state),
  (country, status), (country), (status), ())"""

Q["lead_cube"] = f"""{S.W}, g AS (
  SELECT unnest(CASE WHEN len(channels) > 0 THEN channels ELSE [CAST(NULL AS VARCHAR)] END) AS channel, status,
    CASE WHEN score >= 70 THEN 'hot' WHEN score >= 40 THEN 'warm' ELSE 'cold' END AS band, score, has_email FROM fx_leads)
SELECT {_dims(['channel', 'status', 'band'])}, {_SUMS} FROM g GROUP BY CUBE (channel, status, band)"""

Q["distinct_sketches"] = f"""{D.FIX}, {D.HITS_HOSTS}
SELECT CAST(provider_ord AS BIGINT) AS provider_ord, count(DISTINCT host) AS domains, true AS close
FROM serp LEFT JOIN hh ON serp.url = hh.url GROUP BY 1"""

Q["global_ntile"] = f"""{S.W} SELECT id, ntile(10) OVER (ORDER BY score DESC, id) AS decile FROM fx_leads"""

Q["quantiles"] = " UNION ALL ".join(
    f"SELECT CAST({p} AS DOUBLE) AS probability, round(quantile_cont(value, {p}), 6) AS value FROM events"
    for p in (0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0))

Q["change_history"] = f"""WITH v0 AS (SELECT id, status, notes, {S.tstr('updated_at')} AS updated_at FROM ({S.W} SELECT * FROM fx_leads)),
v1 AS ({S.Q['patch_leads']}), v2 AS ({S.Q['delete_leads']}),
d AS (SELECT v0.id, v0.status IS DISTINCT FROM v1.status OR v0.notes IS DISTINCT FROM v1.notes OR v0.updated_at IS DISTINCT FROM v1.updated_at AS changed,
        v0.id NOT IN (SELECT id FROM v2) AS deleted FROM v0 JOIN v1 ON v0.id = v1.id)
SELECT v0.id, CAST(0 AS BIGINT) AS valid_from, CAST(CASE WHEN changed THEN 1 WHEN deleted THEN 2 END AS BIGINT) AS valid_to, 'insert' AS change,
  v0.status, v0.notes, v0.updated_at FROM v0 JOIN d ON v0.id = d.id
UNION ALL
SELECT v1.id, 1, CASE WHEN deleted THEN 2 END, 'update', v1.status, v1.notes, v1.updated_at FROM v1 JOIN d ON v1.id = d.id WHERE changed"""

_DRIFT = """WITH e AS (SELECT event_id, props, event_id AS i, regexp_extract(props, '[0-9]+') AS k FROM events),
d AS (SELECT event_id, CASE
    WHEN i % 13 = 1 THEN '{"k": "' || k || '"}' WHEN i % 17 = 2 THEN '{"k": {"v": ' || k || '}, "src": "a"}'
    WHEN i % 19 = 3 THEN '{"k": ' || k || ', "ref": "x' || i || '", "w": ' || k || '.5}' WHEN i % 23 = 4 THEN '{"k": ' || k
    WHEN i % 29 = 5 THEN NULL WHEN i % 31 = 6 THEN '[' || k || ']' WHEN i % 37 = 7 THEN '{"k": null}' WHEN i % 41 = 8 THEN '{"k": ' || k || '.25}'
    WHEN i % 43 = 9 THEN '{"items": [{"sku": "a", "n": 1}, {"sku": ' || i || ', "n": "2"}, 3]}' ELSE props END AS p FROM e),
j AS (SELECT event_id, p, CASE WHEN json_valid(p) THEN CAST(p AS JSON) END AS j FROM d)"""


def _long(path: str, j: str = "j") -> str:
    return f"CASE WHEN json_type({j}, '{path}') IN ('UBIGINT', 'BIGINT', 'VARCHAR') THEN TRY_CAST({j}->>'{path}' AS BIGINT) END"


Q["drifting_payloads"] = f"""{_DRIFT}
SELECT event_id, {_long('$.k')} AS k, j->>'$.ref' AS ref, CAST(j->>'$.w' AS DOUBLE) AS w,
  CASE WHEN p IS NULL THEN 'no payload' WHEN j IS NULL THEN 'malformed' WHEN json_type(j) <> 'OBJECT' THEN 'not an object'
    WHEN json_type(j, '$.k') = 'OBJECT' THEN 'k: object' WHEN json_type(j, '$.k') = 'DOUBLE' THEN 'k: number' END AS reason,
  CASE WHEN json_type(j) = 'OBJECT' THEN array_to_string(list_sort(list_filter(json_keys(j), lambda n: n NOT IN ('k', 'ref', 'w'))), '; ') END AS unknown
FROM j"""

Q["payload_items"] = f"""{_DRIFT},
x AS (SELECT event_id, unnest(json_extract(j, '$.items[*]')) AS x, generate_subscripts(json_extract(j, '$.items[*]'), 1) - 1 AS pos FROM j WHERE json_type(j, '$.items') = 'ARRAY')
SELECT event_id, CAST(pos AS BIGINT) AS pos, x->>'$.sku' AS sku, {_long('$.n', 'x')} AS n, CASE WHEN json_type(x) <> 'OBJECT' THEN 'not an object' END AS reason FROM x"""

Q["payload_shape"] = f"""{_DRIFT},
f AS (SELECT j, unnest(json_keys(j)) AS field FROM j WHERE json_type(j) = 'OBJECT'),
t AS (SELECT field, json_type(j, '$.' || field) AS t FROM f)
SELECT field, CASE WHEN t = 'VARCHAR' THEN 'string' WHEN t IN ('OBJECT', 'ARRAY', 'BOOLEAN', 'NULL') THEN lower(t) ELSE 'number' END AS kind,
  count(*) AS n FROM t GROUP BY 1, 2"""

Q["stream_captures"] = "SELECT page_id, url, md5(html) AS html_md5 FROM pages"
