"""Oracle SQL for planning, hosts/names and discovery jobs."""

from __future__ import annotations

from leadlake import constants as K
from oracle import namesql as NS
from oracle import pagesql as PS
from oracle import plansql as PL
from oracle.fixtures_sql import RICH_PAGES
from oracle.sqlkit import join, lit, odistinct

Q: dict[str, str] = {}
BASE = "WITH " + PL.base_ctes()
FIX = "WITH " + PL.fixture_ctes()


def host_expr(u: str) -> str:
    """host_of(u) as one expression (null when unparsable)."""
    cu = PS.clean_url(u)
    auth = f"regexp_extract({cu}, {lit(PS.ABS)}, 2)"
    host = f"lower(regexp_extract({auth}, {lit(PS.AUTH)}, 1))"
    port = f"regexp_extract({auth}, {lit(PS.AUTH)}, 2)"
    scheme = f"lower(regexp_extract({cu}, {lit(PS.ABS)}, 1))"
    ok = (f"(regexp_matches({cu}, {lit(PS.ABS)}) AND {scheme} <> '' AND {host} <> '' "
          f"AND NOT regexp_matches({host}, {lit(PS.BAD_HOST)}) AND regexp_matches({port}, '^[0-9]{{0,5}}\\z'))")
    return f"(CASE WHEN {ok} THEN regexp_replace({host}, '^www[.]', '') END)"


# ------------------------------------------------------------------ planning

Q["normalize_specs"] = f"""{BASE}
SELECT CAST(spec_ord AS BIGINT) AS spec_ord, niche, location, CAST(lim AS BIGINT) AS lim,
  coalesce(array_to_string(channels, '; '), '<all>') AS channels FROM specs"""

Q["normalize_specs_saved"] = f"""WITH fx_specs AS ({PL.FX_SPECS}), s AS ({PL.norm_specs('fx_specs', 'saved')})
SELECT CAST(spec_ord AS BIGINT) AS spec_ord, CAST(lim AS BIGINT) AS lim FROM s"""

Q["spec_channels"] = f"""{BASE}
SELECT CAST(spec_ord AS BIGINT) AS spec_ord, channel, CAST(channel_ord AS BIGINT) AS channel_ord FROM sch"""


def _expand(arr: str, channel: str) -> str:
    return f"""{BASE}
SELECT CAST(spec_ord AS BIGINT) AS spec_ord, {lit(channel)} AS channel, CAST(qo - 1 AS BIGINT) AS query_ord,
  qq.query AS query, CAST(qq.depth AS BIGINT) AS depth, label
FROM (SELECT *, unnest(qa) AS qq, generate_subscripts(qa, 1) AS qo
      FROM (SELECT *, {arr} AS qa, {PL.LABEL} AS label FROM specs))"""


Q["expand_web_queries"] = _expand(PL.web_q(), "web")
Q["expand_linkedin_queries"] = _expand(PL.linkedin_q(), "linkedin")
Q["expand_intent_queries"] = _expand(PL.intent_q(), "quora")
Q["expand_listing_queries"] = _expand(PL.listing_q(), "yellowpages")
Q["expand_places_queries"] = _expand(PL.places_q(), "googlemaps")
Q["expand_profile_queries"] = " UNION ALL ".join(
    f"SELECT * FROM ({_expand(PL.profile_q(c), c)})" for c in ("clutch", "g2", "crunchbase"))

Q["plan_queries"] = f"""{BASE}
SELECT CAST(spec_ord AS BIGINT) AS spec_ord, channel, CAST(channel_ord AS BIGINT) AS channel_ord,
  CAST(query_ord AS BIGINT) AS query_ord, query, CAST(depth AS BIGINT) AS depth, label FROM planned"""

GEO = """geo AS (
  SELECT 'R' || r_regionkey AS country_code,
    CASE WHEN r_regionkey = 1 THEN 'United States' ELSE r_name END AS country,
    'N' || n_nationkey AS state_code, n_name AS state,
    CASE WHEN c_custkey % 11 = 0 THEN ' ' ELSE 'City ' || (c_custkey % 37) END AS city
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def compose(city: str, state: str, country: str) -> str:
    parts = f"list_filter([{NS.trim_js('coalesce(' + city + ', ' + lit('') + ')')}, coalesce({state}, '')], lambda p: p <> '')"
    cn = f"coalesce({country}, '')"
    parts2 = f"(CASE WHEN {cn} <> '' AND {cn} <> 'United States' THEN list_append({parts}, {cn}) ELSE {parts} END)"
    return f"(CASE WHEN len({parts2}) = 0 THEN {cn} ELSE array_to_string({parts2}, ', ') END)"


Q["compose_location"] = f"""WITH {GEO}
SELECT country_code, state_code, city, {compose('city', 'state', 'country')} AS location,
  {compose('NULL', 'NULL', 'country')} AS country_only, {compose('NULL', 'state', 'country')} AS state_only
FROM (SELECT DISTINCT * FROM geo)"""

Q["location_cascade"] = f"""WITH {GEO}
SELECT DISTINCT 'country' AS level, '' AS parent, country AS name, country_code AS iso_code FROM geo
UNION ALL SELECT DISTINCT 'state', country_code, state, state_code FROM geo
UNION ALL SELECT DISTINCT 'city', country_code || '/' || state_code, city, '' FROM geo"""

# ------------------------------------------------------------------ hosts and names

HITS_HOSTS = f"hh AS (SELECT url, {host_expr('url')} AS host FROM (SELECT DISTINCT url FROM serp))"

Q["host_of"] = f"""{FIX}, {HITS_HOSTS}
SELECT url, host FROM hh"""

Q["is_aggregator"] = f"""{FIX}, {HITS_HOSTS}
SELECT host, {NS.is_aggregator('host')} AS aggregator, {NS.is_microsite('host')} AS microsite
FROM (SELECT DISTINCT host FROM hh WHERE host IS NOT NULL)"""

Q["is_microsite"] = f"""{FIX}, {HITS_HOSTS}
SELECT host FROM (SELECT DISTINCT host FROM hh WHERE host IS NOT NULL) WHERE {NS.is_microsite('host')}"""

Q["exclude_known"] = f"""{FIX}, {HITS_HOSTS}
SELECT domain FROM (SELECT DISTINCT host AS domain FROM hh WHERE host IS NOT NULL)
WHERE domain NOT IN (SELECT domain FROM known WHERE domain IS NOT NULL)"""

Q["website_contact_url"] = f"""{FIX}, {HITS_HOSTS}
SELECT host, 'https://' || host AS website, 'https://' || host || '/contact' AS contact_url
FROM (SELECT DISTINCT host FROM hh WHERE host IS NOT NULL)"""

Q["domain_matches_name"] = f"""{FIX},
x AS (SELECT DISTINCT name, host FROM (
  SELECT regexp_extract(query, '^"([^"]+)"', 1) AS name, {host_expr('url')} AS host FROM serp_resolve)
  WHERE name <> '' AND host IS NOT NULL)
SELECT name, host, {NS.domain_matches('host', 'name')} AS matches FROM x"""

_DOM = ("CASE channel WHEN 'clutch' THEN 'clutch.co' WHEN 'g2' THEN 'g2.com' WHEN 'crunchbase' THEN 'crunchbase.com' "
        "WHEN 'linkedin' THEN 'linkedin.com' WHEN 'yellowpages' THEN 'yellowpages.com' WHEN 'quora' THEN 'quora.com' "
        "WHEN 'googlemaps' THEN 'google.com' END")
_REJ = lit("(?i)" + K.PROFILE_URL_REJECT)

Q["profile_hit_filter"] = f"""{FIX},
ph AS (SELECT query, url FROM serp_profile)
SELECT DISTINCT channel, url, coalesce({host_expr('url')} = ({_DOM}), false) AND NOT regexp_matches(url, {_REJ}) AS kept
FROM ph JOIN (SELECT DISTINCT query, channel FROM planned) USING (query)"""

TITLES = f"tt AS (SELECT DISTINCT title, host FROM (SELECT title, {host_expr('url')} AS host FROM (SELECT DISTINCT url, title FROM serp)) WHERE host IS NOT NULL)"

Q["derive_name"] = f"""{FIX}, {TITLES}
SELECT title, host, {NS.derive_name('title', 'host')} AS name, {NS.derive_name('NULL', 'host')} AS host_name FROM tt"""

Q["looks_like_listicle"] = f"""{FIX}
SELECT title, {NS.listicle('title')} AS listicle FROM (SELECT DISTINCT title FROM serp)"""

Q["clean_name_from_domain"] = f"""{FIX}, {HITS_HOSTS},
ah AS (SELECT host FROM hh WHERE host IS NOT NULL
       UNION SELECT {host_expr('website_uri')} FROM places WHERE {host_expr('website_uri')} IS NOT NULL)
SELECT host, {NS.clean_name('host')} AS name FROM (SELECT DISTINCT host FROM ah)"""

Q["pick_name"] = f"""{FIX}, {TITLES}
SELECT title, host, {NS.pick_name('title', 'host')} AS name FROM tt"""

Q["extract_company_name"] = f"""{FIX}
SELECT title, {NS.company_name('title')} AS name FROM (SELECT DISTINCT title FROM serp_profile)"""

HITS = """hits AS (
  SELECT p.*, h.rank, h.url, h.title, h.description
  FROM planned p
  JOIN (SELECT * FROM serp WHERE provider_ord = (SELECT min(provider_ord) FROM serp s2 WHERE s2.query = serp.query)) h
    USING (query)
  WHERE h.rank <= p.depth)"""

Q["extract_names_listing"] = f"""{FIX}, {HITS}
SELECT description, niche, array_to_string({NS.names_listing('description', 'niche')}, '; ') AS names
FROM (SELECT DISTINCT description, niche FROM hits WHERE channel = 'yellowpages')"""

Q["extract_names_bullets"] = f"""{FIX}
SELECT description, array_to_string({NS.names_bullets('description')}, '; ') AS names
FROM (SELECT DISTINCT description FROM serp_profile)"""

Q["brand_name"] = f"""WITH src AS ({RICH_PAGES}), {PS.signals_cte('src', 'page_id')}
SELECT page_id, {NS.brand('og_title', 'title')} AS brand FROM sig"""

Q["place_description"] = f"""{FIX}
SELECT query, CAST(page_no AS BIGINT) AS page_no, CAST(pos AS BIGINT) AS pos,
  {NS.place_description('address', 'rating', 'rating_count')} AS description FROM places"""

# ------------------------------------------------------------------ discovery

Q["provider_fallback"] = f"""{FIX}
SELECT query, CAST(provider_ord AS BIGINT) AS provider_ord, CAST(rank AS BIGINT) AS rank, url
FROM serp WHERE provider_ord = (SELECT min(provider_ord) FROM serp s2 WHERE s2.query = serp.query)"""

Q["top_hits"] = f"""{FIX}, {HITS}
SELECT CAST(spec_ord AS BIGINT) AS spec_ord, channel, CAST(query_ord AS BIGINT) AS query_ord,
  CAST(rank AS BIGINT) AS rank, url FROM hits"""

CAND_OUT = """CAST(spec_ord AS BIGINT) AS spec_ord, channel, CAST(channel_ord AS BIGINT) AS channel_ord,
  CAST(o1 AS BIGINT) AS o1, CAST(o2 AS BIGINT) AS o2, CAST(o3 AS BIGINT) AS o3,
  name, website, domain, description, query, phone"""

BLOCK = NS.is_blocked

WEB = f"""web AS (
  SELECT spec_ord, 'web' AS channel, channel_ord, query_ord AS o1, rank AS o2, 0 AS o3,
    {NS.pick_name('title', 'host')} AS name, 'https://' || host AS website, host AS domain, description, query,
    CAST(NULL AS VARCHAR) AS phone
  FROM (
    SELECT *, row_number() OVER (PARTITION BY spec_ord, channel_ord ORDER BY query_ord, rank) AS rn
    FROM (
      SELECT *, row_number() OVER (PARTITION BY spec_ord, channel_ord, host ORDER BY query_ord, rank) AS hr
      FROM (SELECT *, {host_expr('url')} AS host FROM hits WHERE channel = 'web')
      WHERE host IS NOT NULL AND NOT {BLOCK('host')} AND host NOT IN (SELECT domain FROM known WHERE domain IS NOT NULL))
    WHERE hr = 1)
  WHERE rn <= lim)"""

INTENT = f"""intent AS (
  SELECT spec_ord, 'quora' AS channel, channel_ord, query_ord AS o1, rank AS o2, 0 AS o3,
    {NS.derive_name('NULL', 'host')} AS name, 'https://' || host AS website, host AS domain, description,
    label AS query, CAST(NULL AS VARCHAR) AS phone
  FROM (
    SELECT *, row_number() OVER (PARTITION BY spec_ord, channel_ord, host ORDER BY query_ord, rank) AS hr
    FROM (SELECT *, {host_expr('url')} AS host FROM hits WHERE channel = 'quora')
    WHERE host IS NOT NULL AND NOT {BLOCK('host')})
  WHERE hr = 1)"""

PLACES = f"""gplaces AS (
  SELECT spec_ord, 'googlemaps' AS channel, channel_ord, page_no AS o1, pos AS o2, 0 AS o3,
    coalesce(pname, {NS.clean_name('host')}) AS name, 'https://' || host AS website, host AS domain,
    description, label AS query, phone
  FROM (
    SELECT *, row_number() OVER (PARTITION BY spec_ord, channel_ord, host ORDER BY page_no, pos) AS hr
    FROM (
      SELECT p.spec_ord, p.channel_ord, p.label, pl.page_no, pl.pos, {host_expr('pl.website_uri')} AS host,
        CASE WHEN coalesce(pl.name_text, '') <> '' THEN pl.name_text END AS pname,
        coalesce(CASE WHEN pl.national_phone <> '' THEN pl.national_phone END,
                 CASE WHEN pl.international_phone <> '' THEN pl.international_phone END) AS phone,
        {NS.place_description('pl.address', 'pl.rating', 'pl.rating_count')} AS description
      FROM (SELECT DISTINCT spec_ord, channel_ord, query, label FROM planned WHERE channel = 'googlemaps') p
      JOIN places pl USING (query)
      WHERE pl.page_no < 3 AND coalesce(pl.website_uri, '') <> '')
    WHERE host IS NOT NULL AND NOT {BLOCK('host')})
  WHERE hr = 1)"""


def resolved(names_cte: str, limit: bool, out: str) -> str:
    """names_cte has spec_ord, channel, channel_ord, name_ord, name, location, label, lim."""
    lim = "WHERE rn <= lim" if limit else ""
    dom = _DOM
    return f"""{out}_rq AS (
  SELECT n.*, rq.rq_ord, rq.rquery FROM {names_cte} n,
    (SELECT 0 AS rq_ord UNION ALL SELECT 1) r0,
    LATERAL (SELECT r0.rq_ord,
      CASE WHEN r0.rq_ord = 0 THEN '"' || n.name || '"' || (CASE WHEN n.location IS NOT NULL THEN ' ' || n.location ELSE '' END) || ' official website'
           ELSE n.name || (CASE WHEN n.location IS NOT NULL THEN ' ' || n.location ELSE '' END) || ' website' END AS rquery) rq),
{out}_res AS (
  SELECT spec_ord, channel, name, host FROM (
    SELECT *, row_number() OVER (PARTITION BY spec_ord, channel, name ORDER BY rq_ord, rank) AS rr
    FROM (
      SELECT q.spec_ord, q.channel, q.name, q.rq_ord, h.rank, {host_expr('h.url')} AS host
      FROM (SELECT DISTINCT spec_ord, channel, name, location, rq_ord, rquery FROM {out}_rq) q
      JOIN (SELECT * FROM serp WHERE provider_ord = (SELECT min(provider_ord) FROM serp s2 WHERE s2.query = serp.query)) h
        ON h.query = q.rquery AND h.rank <= 5)
    WHERE host IS NOT NULL AND NOT {BLOCK('host')}
      AND NOT (host = ({dom.replace('channel', 'channel')}) OR ends_with(host, '.' || ({dom})))
      AND {NS.domain_matches('host', 'name')})
  WHERE rr = 1),
{out} AS (
  SELECT spec_ord, channel, channel_ord, no1 AS o1, no2 AS o2, no3 AS o3, name, 'https://' || host AS website,
    host AS domain, CAST(NULL AS VARCHAR) AS description, label AS query, CAST(NULL AS VARCHAR) AS phone
  FROM (
    SELECT *, row_number() OVER (PARTITION BY spec_ord, channel ORDER BY no1, no2, no3) AS rn FROM (
      SELECT n.*, r.host, row_number() OVER (PARTITION BY n.spec_ord, n.channel, n.channel_ord, r.host ORDER BY n.no1, n.no2, n.no3) AS hr
      FROM {names_cte} n JOIN {out}_res r USING (spec_ord, channel, name))
    WHERE hr = 1)
  {lim})"""


def numbered(src: str) -> str:
    """src has spec_ord, channel, channel_ord, location, label, lim, name, k1..k4."""
    return f"""SELECT spec_ord, channel, channel_ord, name, location, label, lim,
    CAST(k1 AS BIGINT) AS no1, CAST(k2 AS BIGINT) * 1000000 + k3 AS no2, CAST(k4 AS BIGINT) AS no3
  FROM (SELECT *, row_number() OVER (PARTITION BY spec_ord, channel, channel_ord, name ORDER BY k1, k2, k3, k4) AS fr
        FROM ({src})) WHERE fr = 1"""


_LABEL_OF = ("CASE channel WHEN 'clutch' THEN 'clutch' WHEN 'g2' THEN 'g2' WHEN 'crunchbase' THEN 'crunchbase' "
             "WHEN 'linkedin' THEN 'linkedin' END")

LISTING = f"""listing_names AS ({numbered(f'''
  SELECT spec_ord, channel, channel_ord, location, label, lim, nm AS name, query_ord AS k1, rank AS k2, pos AS k3, 0 AS k4
  FROM (SELECT *, unnest(nl) AS nm, generate_subscripts(nl, 1) - 1 AS pos
        FROM (SELECT *, {NS.names_listing('description', 'niche')} AS nl FROM hits WHERE channel = 'yellowpages'))
  WHERE length(nm) BETWEEN 4 AND 60''')}),
{resolved('listing_names', False, 'listing')}"""

PROFILE = f"""ph AS (SELECT * FROM (SELECT *, {host_expr('url')} AS rhost FROM hits
                       WHERE channel IN ('clutch', 'g2', 'crunchbase', 'linkedin'))
            WHERE coalesce(rhost = ({_DOM}), false)),
profile_names AS ({numbered(f'''
  SELECT spec_ord, channel, channel_ord, location, label, lim, name, 0 AS k1, query_ord AS k2, rank AS k3, 0 AS k4
  FROM (SELECT *, {NS.company_name('title')} AS name FROM ph WHERE NOT regexp_matches(url, {_REJ}))
  WHERE name IS NOT NULL AND lower(name) <> channel
    AND lower(name) <> lower(CASE channel WHEN 'clutch' THEN 'Clutch' WHEN 'g2' THEN 'G2'
                                 WHEN 'crunchbase' THEN 'Crunchbase' ELSE 'LinkedIn' END)
  UNION ALL
  SELECT spec_ord, channel, channel_ord, location, label, lim, nm, 1, query_ord, rank, pos
  FROM (SELECT *, unnest(bl) AS nm, generate_subscripts(bl, 1) - 1 AS pos
        FROM (SELECT *, {NS.names_bullets('description')} AS bl FROM ph WHERE channel = 'g2'))''')}),
{resolved('profile_names', True, 'profile')}"""

CHANNELS = f"""{HITS}, {WEB}, {INTENT}, {PLACES}, {LISTING}, {PROFILE},
cands AS (SELECT * FROM web UNION ALL SELECT * FROM listing UNION ALL SELECT * FROM intent
          UNION ALL SELECT * FROM profile UNION ALL SELECT * FROM gplaces)"""

for name, cte in [("discover_web", WEB), ("discover_intent", INTENT), ("discover_places", PLACES),
                  ("discover_listing", LISTING), ("discover_profile", PROFILE)]:
    tbl = {"discover_web": "web", "discover_intent": "intent", "discover_places": "gplaces",
           "discover_listing": "listing", "discover_profile": "profile"}[name]
    Q[name] = f"""{FIX}, {HITS}, {cte}
SELECT {CAND_OUT} FROM {tbl}"""

Q["resolve_websites"] = f"""{FIX},
rn0 AS (SELECT DISTINCT p.spec_ord, p.channel, p.location, {NS.company_name('s.title')} AS name, 0 AS channel_ord,
               0 AS no1, 0 AS no2, 0 AS no3, '' AS label, 0 AS lim
        FROM serp_profile s JOIN (SELECT DISTINCT query, spec_ord, channel, location FROM planned) p USING (query)),
rn1 AS (SELECT * FROM rn0 WHERE name IS NOT NULL),
{resolved('rn1', False, 'rv')}
SELECT CAST(spec_ord AS BIGINT) AS spec_ord, channel, name, host FROM rv_res"""

Q["discover_channels"] = f"""{FIX}, {CHANNELS}
SELECT {CAND_OUT} FROM cands"""

Q["per_channel_counts"] = f"""{FIX}, {CHANNELS},
kept AS (SELECT spec_ord, channel, count(*) AS n FROM cands
         WHERE domain NOT IN (SELECT domain FROM known WHERE domain IS NOT NULL) GROUP BY ALL)
SELECT CAST(s.spec_ord AS BIGINT) AS spec_ord, s.channel, CAST(coalesce(k.n, 0) AS BIGINT) AS kept
FROM (SELECT DISTINCT spec_ord, channel FROM planned) s LEFT JOIN kept k USING (spec_ord, channel)"""

MERGED = f"""{CHANNELS},
kc AS (SELECT * FROM cands WHERE domain NOT IN (SELECT domain FROM known WHERE domain IS NOT NULL)),
chf AS (SELECT spec_ord, domain, channel, min((channel_ord, o1, o2, o3)) AS k FROM kc GROUP BY ALL),
merged AS (
  SELECT spec_ord, domain,
    coalesce(arg_min(name, (channel_ord, o1, o2, o3)) FILTER (WHERE length(name) >= 3),
             arg_min(name, (channel_ord, o1, o2, o3))) AS name,
    arg_min(website, (channel_ord, o1, o2, o3)) AS website,
    arg_min(query, (channel_ord, o1, o2, o3)) AS query,
    arg_min(phone, (channel_ord, o1, o2, o3)) FILTER (WHERE coalesce(phone, '') <> '') AS phone,
    arg_min(description, (channel_ord, o1, o2, o3)) FILTER (WHERE coalesce(description, '') <> '') AS description,
    min((channel_ord, o1, o2, o3)) AS first_ord,
    (SELECT list(channel ORDER BY k) FROM chf WHERE chf.spec_ord = kc.spec_ord AND chf.domain = kc.domain) AS channels
  FROM kc GROUP BY spec_ord, domain),
capped AS (
  SELECT * FROM (
    SELECT m.*, s.lim, row_number() OVER (PARTITION BY m.spec_ord ORDER BY len(m.channels) DESC, m.first_ord) AS cand_rank
    FROM merged m JOIN specs s USING (spec_ord))
  WHERE cand_rank <= greatest(3 * lim, 40))"""

Q["merge_candidates"] = f"""{FIX}, {MERGED}
SELECT CAST(spec_ord AS BIGINT) AS spec_ord, domain, name, website, query, phone, description,
  array_to_string(channels, '; ') AS channels FROM merged"""

Q["cap_candidates"] = f"""{FIX}, {MERGED}
SELECT CAST(spec_ord AS BIGINT) AS spec_ord, domain, CAST(cand_rank AS BIGINT) AS cand_rank,
  array_to_string(channels, '; ') AS channels FROM capped"""


# ------------------------------------------------------------------ enrichment and leads

def leads_ctes(capped: str, enrich: bool = True) -> str:
    """CTEs ep (enriched pages), en (enriched candidates), fo (phone folded), ld (leads)."""
    if not enrich:
        en = f"""en AS (SELECT c.*, false AS ok, CAST(NULL AS VARCHAR[]) AS emails, CAST(NULL AS VARCHAR[]) AS phones,
  CAST(NULL AS VARCHAR[]) AS socials, CAST(NULL AS VARCHAR) AS contact_url, CAST(NULL AS VARCHAR) AS brand,
  CAST(NULL AS INTEGER) AS opp, CAST(NULL AS VARCHAR[]) AS issues, CAST(NULL AS INTEGER) AS seo_status
  FROM {capped} c)"""
    else:
        en = f"""cu AS (SELECT *, 'https://' || domain || '/contact' AS cu FROM {capped}),
ep_src AS (SELECT url AS page_key, url, status_code, html FROM home
           WHERE url IN (SELECT website FROM cu UNION SELECT cu FROM cu)),
{PS.signals_cte('ep_src', 'page_key')},
ep0 AS (SELECT *, {PS.emails('text')} AS emails, {PS.phones('text')} AS phones,
               {PS.socials('external')} AS socials, {NS.brand('og_title', 'title')} AS brand FROM sig),
ep AS (SELECT page_key AS url, coalesce(status_code BETWEEN 200 AND 299, false) AS success,
              opportunity_score, issues, status_code, emails, phones, socials, brand
       FROM ({PS.audit_cte('ep0')})),
j1 AS (SELECT c.*, coalesce(h.success, false) AS ok, h.emails AS h_emails, h.phones AS h_phones,
              h.socials AS h_socials, h.brand AS h_brand, h.opportunity_score AS h_opp, h.issues AS h_issues,
              h.status_code AS h_status
       FROM cu c LEFT JOIN ep h ON c.website = h.url),
j2 AS (SELECT j1.*, x.url AS x_url, x.emails AS x_emails, x.phones AS x_phones, x.socials AS x_socials
       FROM j1 LEFT JOIN (SELECT * FROM ep WHERE success) x
         ON x.url = (CASE WHEN j1.ok AND len(j1.h_emails) = 0 THEN j1.cu END)),
en AS (SELECT * EXCLUDE (x_url, x_emails, x_phones, x_socials, h_emails, h_phones, h_socials, h_brand, h_opp, h_issues,
                         h_status, cu),
  CASE WHEN ok THEN m_emails END AS emails, CASE WHEN ok THEN m_phones END AS phones,
  CASE WHEN ok THEN m_socials END AS socials,
  CASE WHEN ok AND x_url IS NOT NULL AND (len(m_emails) > 0 OR len(m_phones) > 0) THEN cu END AS contact_url,
  CASE WHEN ok THEN h_brand END AS brand, CASE WHEN ok THEN h_opp END AS opp,
  CASE WHEN ok THEN h_issues END AS issues, CASE WHEN ok THEN h_status END AS seo_status
  FROM (SELECT *,
    CASE WHEN x_url IS NOT NULL THEN x_emails ELSE h_emails END AS m_emails,
    CASE WHEN x_url IS NOT NULL THEN {PS.clean_distinct('list_concat(h_phones, x_phones)')} ELSE h_phones END AS m_phones,
    CASE WHEN x_url IS NOT NULL THEN {PS.clean_distinct('list_concat(h_socials, x_socials)')} ELSE h_socials END AS m_socials
    FROM j2))"""
    digits = "regexp_replace({}, '[^0-9]', '', 'g')"
    has_phone = "(phone IS NOT NULL AND phone <> '')"
    known = f"len(list_filter(coalesce(phones, []), lambda p: {digits.format('p')} = {digits.format('phone')})) > 0"
    return f"""{en},
fo AS (SELECT * EXCLUDE (emails, phones, socials, contact_url),
  CASE WHEN NOT {has_phone} THEN ok ELSE true END AS has_out,
  CASE WHEN NOT {has_phone} THEN emails ELSE coalesce(emails, []) END AS emails,
  CASE WHEN NOT {has_phone} THEN phones WHEN {known} THEN coalesce(phones, [])
       ELSE list_append(coalesce(phones, []), phone) END AS phones,
  CASE WHEN NOT {has_phone} THEN socials ELSE coalesce(socials, []) END AS socials,
  contact_url
  FROM en),
ld AS (SELECT *, coalesce(brand, name) AS lead_name,
  {PS.score_cols('ok', 'opp', 'len(issues)', 'seo_status', 'has_out', 'len(emails)', 'len(phones)', 'len(socials)', '0')}
  FROM fo)"""


LEAD_OUT = """CAST(spec_ord AS BIGINT) AS spec_ord, domain, lead_name AS name, website, query,
  array_to_string(channels, '; ') AS channels, CAST(score AS BIGINT) AS score,
  array_to_string(reasons, '; ') AS reasons, array_to_string(emails, '; ') AS emails,
  array_to_string(phones, '; ') AS phones, array_to_string(socials, '; ') AS socials, contact_url,
  has_out AS has_outreach, ok AS has_seo, CAST(opp AS BIGINT) AS opportunity_score,
  array_to_string(issues, '; ') AS issues"""

Q["enrich"] = f"""{FIX}, {MERGED}, {leads_ctes('capped')}
SELECT CAST(spec_ord AS BIGINT) AS spec_ord, domain, ok AS enriched,
  CASE WHEN ok THEN array_to_string(emails, '; ') END AS emails,
  CASE WHEN ok THEN array_to_string(phones, '; ') END AS phones,
  CASE WHEN ok THEN array_to_string(socials, '; ') END AS socials, contact_url,
  CAST(opp AS BIGINT) AS opportunity_score, brand FROM en"""

Q["fold_phone"] = f"""{FIX}, {MERGED}, {leads_ctes('capped')}
SELECT CAST(spec_ord AS BIGINT) AS spec_ord, domain, phone,
  CASE WHEN has_out THEN array_to_string(phones, '; ') END AS phones, has_out AS has_outreach FROM fo"""

Q["build_leads"] = f"""{FIX}, {MERGED}, {leads_ctes('capped')}
SELECT {LEAD_OUT} FROM ld"""

Q["build_leads_no_enrich"] = f"""{FIX}, {MERGED}, {leads_ctes('capped', enrich=False)}
SELECT {LEAD_OUT} FROM ld"""

Q["run_search"] = Q["build_leads"]

# specs one after another: the web channel takes its first lim hosts, and the cap counts, after the domains that
# the specs before kept are gone
_ALL_WEB = WEB.replace("web AS (", "all_web AS (", 1).replace("WHERE rn <= lim)", ")", 1)


def _merged_of(src: str, name: str) -> str:
    """The merge of the candidates ``src`` as ``name``."""
    text = MERGED.split("chf AS", 1)[1].split(",\ncapped AS", 1)[0]
    text = "chf AS" + text
    return (text.replace("chf", f"chf_{name}").replace("merged AS", f"{name} AS").replace("FROM kc GROUP", f"FROM {src} GROUP")
            .replace("kc.", f"{src}."))


Q["run_discovery"] = f"""{FIX}, {CHANNELS}, {_ALL_WEB},
kc AS (SELECT * FROM cands WHERE channel <> 'web' AND domain NOT IN (SELECT domain FROM known WHERE domain IS NOT NULL)),
webs AS (SELECT spec_ord, list({{'d': domain, 'k': [CAST(channel_ord AS BIGINT), o1, o2, o3]}} ORDER BY o1, o2) AS ws FROM all_web GROUP BY spec_ord),
others AS (
  SELECT spec_ord, list({{'d': domain, 'n': n, 'k': k}}) AS os FROM (
    SELECT spec_ord, domain, count(DISTINCT channel) AS n, min([CAST(channel_ord AS BIGINT), o1, o2, o3]) AS k FROM kc GROUP BY ALL) GROUP BY spec_ord),
numbered AS MATERIALIZED (
  SELECT s.spec_ord, s.lim, greatest(3 * s.lim, 40) AS cap, row_number() OVER (ORDER BY s.spec_ord) AS step,
    coalesce(ws, []) AS ws, coalesce(os, []) AS os FROM specs s LEFT JOIN webs USING (spec_ord) LEFT JOIN others USING (spec_ord)),
loop AS MATERIALIZED (
  WITH RECURSIVE l AS (
    SELECT 0::BIGINT AS step, -1 AS spec_ord, CAST([] AS VARCHAR[]) AS web_kept, CAST([] AS VARCHAR[]) AS kept, CAST([] AS VARCHAR[]) AS taken
    UNION ALL
    SELECT step, spec_ord, list_transform(w, lambda x: x.d), kept, list_concat(taken, kept) FROM (
      SELECT *, list_transform(list_sort(list_transform(
          list_distinct(list_concat(list_transform(w, lambda x: x.d), list_transform(o, lambda x: x.d))),
          lambda d: {{'n': -(coalesce(list_filter(o, lambda x: x.d = d)[1].n, 0) + len(list_filter(w, lambda x: x.d = d))),
                      'k': list_sort(list_concat(list_transform(list_filter(o, lambda x: x.d = d), lambda x: x.k), list_transform(list_filter(w, lambda x: x.d = d), lambda x: x.k)))[1],
                      'd': d}})), lambda s: s.d)[1:cap] AS kept
      FROM (
        SELECT n.step, n.spec_ord, n.cap, l.taken, list_filter(n.ws, lambda x: NOT list_contains(l.taken, x.d))[1:n.lim] AS w,
               list_filter(n.os, lambda x: NOT list_contains(l.taken, x.d)) AS o
        FROM l JOIN numbered n ON n.step = l.step + 1)))
  SELECT * FROM l),
loop_kept AS (SELECT spec_ord, unnest(kept) AS domain FROM loop),
loop_web AS (SELECT spec_ord, unnest(web_kept) AS domain FROM loop),
kc2 AS (
  SELECT c.* FROM kc c JOIN loop_kept USING (spec_ord, domain)
  UNION ALL SELECT w.* FROM all_web w JOIN loop_kept USING (spec_ord, domain) JOIN loop_web USING (spec_ord, domain)),
{_merged_of('kc2', 'capped2')},
{leads_ctes('capped2')}
SELECT {LEAD_OUT} FROM ld"""
