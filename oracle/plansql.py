"""DuckDB SQL: fixtures for specs/hits/places/pages and the query planner."""

from __future__ import annotations

import re

from leadlake import constants as K
from oracle import pagesql as PS
from oracle.sqlkit import lit, odistinct, trim_js

BRANDS = ["Apex", "Nova", "Summit", "Blue River", "Clay", "Bright Path", "Iron Oak", "Zenith"]
SUB1 = ["web", "quora", "googlemaps", "g2", "web", "nope"]
SUB3 = ["linkedin", "clutch", "crunchbase", "yellowpages", "web"]


def arr(items) -> str:
    return "[" + ", ".join(lit(x) for x in items) + "]"


def brand(k: str) -> str:
    return f"(list_extract({arr(BRANDS)}, CAST(({k}) % 8 + 1 AS INTEGER)) || ' ' || CAST({k} AS VARCHAR))"


def slug(b: str) -> str:
    return f"lower(replace({b}, ' ', ''))"


def fill(template: str, vals: dict[str, str]) -> str:
    parts = []
    for piece in re.split(r"(\{[a-z]+\})", template):
        if not piece:
            continue
        if piece.startswith("{") and piece[1:-1] in vals:
            parts.append(vals[piece[1:-1]])
        else:
            parts.append(lit(piece))
    return "(" + " || ".join(parts) + ")"


def q(e: str, depth: int) -> str:
    return f"{{'query': {e}, 'depth': {depth}}}"


V = {"n": "niche", "loc": "location", "site": lit(K.LINKEDIN_SITE)}


def web_q() -> str:
    wl = "[" + ", ".join(q(fill(t, V), K.DEPTH_WEB) for t in K.WEB_TEMPLATES_LOC) + "]"
    wn = "[" + ", ".join(q(fill(t, V), K.DEPTH_WEB) for t in K.WEB_TEMPLATES) + "]"
    full = f"(CASE WHEN location IS NOT NULL THEN {wl} ELSE {wn} END)"
    return f"list_slice({full}, 1, least(len({full}), greatest(5, CAST(ceil(lim / 2) AS INTEGER))))"


def listing_q() -> str:
    e = (f"(CASE WHEN location IS NOT NULL THEN {fill('{n} in {loc} site:yellowpages.com', V)} "
         f"ELSE {fill('{n} site:yellowpages.com', V)} END)")
    return f"[{q(e, K.DEPTH_LISTING)}]"


def intent_q() -> str:
    v = dict(V)
    v["where"] = "(CASE WHEN location IS NOT NULL THEN ' in ' || location ELSE '' END)"
    return "[" + ", ".join(q(fill(t, v), K.DEPTH_INTENT) for t in K.INTENT_TEMPLATES) + "]"


def linkedin_q() -> str:
    wl = "[" + ", ".join(q(fill(t, V), K.DEPTH_PROFILE) for t in K.LINKEDIN_TEMPLATES_LOC) + "]"
    wn = "[" + ", ".join(q(fill(t, V), K.DEPTH_PROFILE) for t in K.LINKEDIN_TEMPLATES) + "]"
    return f"(CASE WHEN location IS NOT NULL THEN {wl} ELSE {wn} END)"


def profile_q(ch: str) -> str:
    site = dict(K.PROFILE_SITE_PATHS)[ch]
    main = (f"(CASE WHEN location IS NOT NULL THEN niche || ' ' || location || ' ' || {lit(site)} "
            f"ELSE niche || ' ' || {lit(site)} END)")
    items = f"[{q(main, K.DEPTH_PROFILE)}]"
    if ch == "g2":
        items = f"list_concat({items}, [" + ", ".join(q(fill(t, V), K.DEPTH_PROFILE_EXTRA) for t in K.G2_EXTRA_TEMPLATES) + "])"
    if ch == "crunchbase":
        items = (f"list_concat({items}, [" + ", ".join(q(fill(t, V), K.DEPTH_PROFILE_EXTRA)
                                                      for t in K.CRUNCHBASE_EXTRA_TEMPLATES) + "])")
    if ch == "linkedin":
        items = f"list_concat({items}, {linkedin_q()})"
    return items


LABEL = "(CASE WHEN location IS NOT NULL THEN niche || ' in ' || location ELSE niche END)"


def places_q() -> str:
    return f"[{q(LABEL, 20 * K.PLACES_MAX_PAGES)}]"


def channel_q() -> str:
    return (f"(CASE channel WHEN 'web' THEN {web_q()} WHEN 'yellowpages' THEN {listing_q()} "
            f"WHEN 'quora' THEN {intent_q()} WHEN 'clutch' THEN {profile_q('clutch')} "
            f"WHEN 'g2' THEN {profile_q('g2')} WHEN 'crunchbase' THEN {profile_q('crunchbase')} "
            f"WHEN 'linkedin' THEN {profile_q('linkedin')} WHEN 'googlemaps' THEN {places_q()} END)")


FX_SPECS = f"""
SELECT spec_ord,
  CASE WHEN spec_ord % 5 = 0 THEN '  ' || seg || ' ' ELSE seg END AS niche,
  CASE WHEN n_nationkey = 3 THEN NULL WHEN spec_ord % 7 = 2 THEN '   ' ELSE n_name || ', TX' END AS location,
  CAST(CASE WHEN spec_ord % 7 = 0 THEN 0 WHEN spec_ord % 7 = 6 THEN 99 ELSE 5 + 5 * (n_nationkey % 3) END AS INTEGER) AS lim,
  CASE WHEN spec_ord % 2 = 0 THEN NULL WHEN spec_ord % 4 = 1 THEN {arr(SUB1)} ELSE {arr(SUB3)} END AS channels
FROM (
  SELECT CAST(row_number() OVER (ORDER BY seg, n_nationkey) - 1 AS INTEGER) AS spec_ord, seg, n_nationkey, n_name
  FROM (SELECT DISTINCT lower(c_mktsegment) AS seg, c_nationkey AS n_nationkey FROM customer)
  JOIN nation USING (n_nationkey)
)"""


def norm_specs(src: str, mode: str = "adhoc") -> str:
    known = arr(K.CHANNEL_IDS)
    ch = odistinct(f"list_filter(channels, lambda c: list_contains({known}, c))")
    if mode == "adhoc":
        limx = "CAST(least(25, greatest(1, CASE WHEN lim IS NULL OR lim = 0 THEN 10 ELSE lim END)) AS INTEGER)"
    else:
        limx = "CAST(CASE WHEN lim > 0 THEN least(50, lim) ELSE 10 END AS INTEGER)"
    return f"""
SELECT spec_ord, {trim_js('niche')} AS niche, nullif({trim_js('location')}, '') AS location,
  {limx} AS lim, CASE WHEN len(ch) > 0 THEN ch END AS channels
FROM (SELECT *, {ch} AS ch FROM {src}) WHERE {trim_js('niche')} <> ''"""


def spec_channels(src: str) -> str:
    return f"""
SELECT spec_ord, niche, location, lim, unnest(cl) AS channel, CAST(generate_subscripts(cl, 1) - 1 AS INTEGER) AS channel_ord
FROM (SELECT *, CASE WHEN len(channels) > 0 THEN channels ELSE {arr(K.CHANNEL_IDS)} END AS cl FROM {src})"""


def plan(src_channels: str) -> str:
    return f"""
SELECT spec_ord, channel, channel_ord, CAST(qo - 1 AS INTEGER) AS query_ord, qq.query AS query,
  CAST(qq.depth AS INTEGER) AS depth, label, niche, location, lim
FROM (SELECT *, unnest(qa) AS qq, generate_subscripts(qa, 1) AS qo
      FROM (SELECT *, {channel_q()} AS qa, {LABEL} AS label FROM {src_channels}))"""


def base_ctes() -> str:
    """CTEs fx_specs, specs (normalised), sch (spec channels), planned (+ query_no)."""
    return f"""fx_specs AS ({FX_SPECS}),
specs AS ({norm_specs('fx_specs')}),
sch AS ({spec_channels('specs')}),
planned AS (SELECT *, row_number() OVER (ORDER BY spec_ord, channel_ord, query_ord) - 1 AS query_no
            FROM ({plan('sch')}))"""


def fixture_ctes() -> str:
    """base_ctes + serp (all hits), places, home (captured pages), known."""
    title = PS.title("html")
    pid = "page_id"
    return f"""{base_ctes()},
sq AS (SELECT query, channel, location, row_number() OVER (ORDER BY query_no) - 1 AS gno
       FROM planned WHERE channel IN ('web', 'quora', 'yellowpages')),
sa AS (SELECT p.page_id, p.url, p.ptitle, t.j, sq.*
       FROM (SELECT page_id, url, coalesce({title}, '') AS ptitle FROM pages) p
       CROSS JOIN range(12) t(j)
       JOIN sq ON sq.gno = (p.page_id * 7 + t.j * 13) % (SELECT count(*) FROM sq)),
serp_web AS (
  SELECT CAST(CASE WHEN gno % 3 = 0 THEN 1 + j % 2 ELSE j % 2 END AS INTEGER) AS provider_ord, query,
    CASE {pid} % 11 WHEN 0 THEN 'https://www.yelp.com/biz/p' || {pid} WHEN 1 THEN 'https://p' || {pid} || '.square.site/'
         WHEN 2 THEN 'notaurl p' || {pid} ELSE url END AS url,
    CASE {pid} % 7 WHEN 0 THEN 'Top 10 ' || ptitle WHEN 1 THEN 'Home - ' || ptitle WHEN 2 THEN ptitle || ' | Brand'
         WHEN 3 THEN ptitle || ', TX' WHEN 4 THEN '' ELSE ptitle END AS title,
    CASE WHEN channel = 'yellowpages' THEN 'Austin, TX 78701. ' || {brand(pid)}
           || ' - Plumbers, open now. 1200 Main St. Call today. From Business: ' || {brand(pid + ' + 1')}
           || ' is a family company.' ELSE 'Snippet ' || {pid} END AS description,
    page_id, j
  FROM sa),
pq AS (SELECT query, channel, location, row_number() OVER (ORDER BY query_no) - 1 AS pno
       FROM planned WHERE channel IN ('clutch', 'g2', 'crunchbase', 'linkedin')),
pa AS (SELECT s.s_suppkey AS k, t.j, pq.*
       FROM supplier s CROSS JOIN range(4) t(j)
       JOIN pq ON pq.pno = (s.s_suppkey * 3 + t.j * 7) % (SELECT count(*) FROM pq)),
serp_profile AS (
  SELECT 0 AS provider_ord, query,
    'https://' || (CASE WHEN k % 10 = 0 THEN 'ai.' || dom WHEN k % 10 = 2 THEN 'www.' || dom ELSE dom END)
      || (CASE WHEN k % 10 = 1 THEN '/compare/' ELSE path END) || 's' || k AS url,
    CASE k % 6 WHEN 0 THEN {brand('k')} || ' - Overview | LinkedIn' WHEN 1 THEN {brand('k')} || ' | Clutch.co'
      WHEN 2 THEN {brand('k')} || ' Reviews 2024: Details, Pricing'
      WHEN 3 THEN {brand('k')} || ' - Crunchbase Company Profile & Funding'
      WHEN 4 THEN 'Top ' || {brand('k')} || ' Agencies' ELSE {brand('k')} END AS title,
    CASE WHEN channel = 'g2' THEN 'Popular: ' || {brand('k')} || ' · Analytics · ' || {brand('k + 1')}
      || ' (1,234) · best · tools like ' || list_extract(['Moz', 'Ahrefs', 'Semrush', 'Ubersuggest'], CAST(k % 4 + 1 AS INTEGER))
      || k || ', Spy' || k || ', and Nova' || k ELSE '' END AS description,
    k, j
  FROM (SELECT *,
    CASE channel WHEN 'clutch' THEN 'clutch.co' WHEN 'g2' THEN 'g2.com' WHEN 'crunchbase' THEN 'crunchbase.com'
      ELSE 'linkedin.com' END AS dom,
    CASE channel WHEN 'clutch' THEN '/profile/' WHEN 'g2' THEN '/products/' WHEN 'crunchbase' THEN '/organization/'
      ELSE '/company/' END AS path FROM pa)),
rnames AS (
  SELECT DISTINCT k, location FROM (
    SELECT k, location FROM pa
    UNION ALL SELECT page_id, location FROM sa WHERE channel = 'yellowpages'
    UNION ALL SELECT page_id + 1, location FROM sa WHERE channel = 'yellowpages'
    UNION ALL SELECT k + 1, location FROM pa)),
rq AS (
  SELECT '"' || {brand('k')} || '"' || lc || ' official website' AS q1, {brand('k')} || lc || ' website' AS q2,
    {slug(brand('k'))} AS sl, {slug(brand('k + 1'))} AS other, k
  FROM (SELECT *, CASE WHEN location IS NOT NULL THEN ' ' || location ELSE '' END AS lc FROM rnames)),
serp_resolve AS (
  SELECT DISTINCT * FROM (
    SELECT q1 AS query, 1 AS rank, 'https://www.yelp.com/biz/' || sl AS url FROM rq
    UNION ALL SELECT q1, 2, CASE WHEN k % 3 = 0 THEN 'https://' || other || '.example.com/'
                               ELSE 'https://www.' || sl || '.example.com/' END FROM rq
    UNION ALL SELECT q2, 1, 'https://' || sl || '-co.example.net/about' FROM rq)),
serp AS (
  SELECT provider_ord, query, CAST(row_number() OVER (PARTITION BY query, provider_ord ORDER BY page_id, j) AS INTEGER) AS rank,
         url, title, description FROM serp_web
  UNION ALL
  SELECT CAST(provider_ord AS INTEGER), query, CAST(row_number() OVER (PARTITION BY query ORDER BY k, j) AS INTEGER),
         url, title, description FROM serp_profile
  UNION ALL
  SELECT 0, query, CAST(rank AS INTEGER), url, '', '' FROM serp_resolve),
gq AS (SELECT query, row_number() OVER (ORDER BY query) - 1 AS gno
       FROM (SELECT DISTINCT query FROM planned WHERE channel = 'googlemaps')),
ga AS (SELECT s.s_suppkey AS k, gq.query FROM supplier s JOIN gq ON gq.gno = s.s_suppkey % (SELECT count(*) FROM gq)),
places AS (
  SELECT query, CAST(floor(p0 / 20) AS INTEGER) AS page_no, CAST(p0 % 20 AS INTEGER) AS pos,
    CASE WHEN k % 13 <> 0 THEN {brand('k')} END AS name_text,
    CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN 'https://www.yelp.com/biz/' || {slug(brand('k'))}
         ELSE 'https://www.' || {slug(brand('k'))} || '.example.com/' END AS website_uri,
    CASE WHEN k % 4 <> 0 THEN '(512) 555-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') END AS national_phone,
    '+1 512-555-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0') AS international_phone,
    CASE WHEN k % 5 <> 0 THEN k || ' Main St, Austin, TX' END AS address,
    CASE WHEN k % 7 <> 0 THEN ((k % 41) + 10) / 10.0 END AS rating,
    CAST(k % 50 AS BIGINT) AS rating_count
  FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY k) - 1 AS p0 FROM ga)),
hp AS (SELECT page_id, html, host, row_number() OVER (PARTITION BY host ORDER BY page_id) AS r
       FROM (SELECT page_id, html, regexp_replace(b_host, '^www[.]', '') AS host
             FROM (SELECT page_id, html, {PS.parts_cols(PS.clean_url('url'), 'b_')} FROM pages) WHERE b_ok)),
home AS (
  SELECT CASE WHEN r = 1 THEN 'https://' || host WHEN r = 2 THEN 'https://' || host || '/contact' ELSE 'https://' || host || '/p' || r END AS url,
    CAST(CASE WHEN r = 2 THEN 200 WHEN page_id % 17 = 0 THEN 404 WHEN page_id % 19 = 0 THEN NULL ELSE 200 END AS INTEGER)
      AS status_code, html
  FROM hp),
known AS (
  SELECT DISTINCT regexp_replace(b_host, '^www[.]', '') AS domain
  FROM (SELECT {PS.parts_cols(PS.clean_url('url'), 'b_')} FROM pages WHERE page_id % 5 = 0) WHERE b_ok)"""
