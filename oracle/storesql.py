"""Oracle SQL: store fixtures, maintenance operators and lead views."""

from __future__ import annotations

from leadlake import constants as K
from oracle import namesql as NS
from oracle.sqlkit import WS, clean_distinct, lit, odistinct

Q: dict[str, str] = {}
NOW = "TIMESTAMP '1999-06-15 12:00:00'"
EP0 = "TIMESTAMP '1970-01-01 00:00:00'"
NOW_EPOCH = 929448000
FALLBACK_EPOCH = 928195200
CH = "[" + ", ".join(lit(c) for c in K.CHANNEL_IDS) + "]"
ST = "[" + ", ".join(lit(s) for s in K.LEAD_STATUSES) + "]"
EMPTY = "CAST([] AS VARCHAR[])"
EMPTY_P = "CAST([] AS STRUCT(name VARCHAR, role VARCHAR)[])"


def ts(epoch: str) -> str:
    return f"({EP0} + to_seconds(CAST({epoch} AS BIGINT)))"


def ep(t: str) -> str:
    return f"date_diff('second', {EP0}, {t})"


def tstr(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%d %H:%M:%S')"


def lpad4(k: str) -> str:
    return f"lpad(CAST({k} % 10000 AS VARCHAR), 4, '0')"


def dom(k: str) -> str:
    return (f"(CASE WHEN {k} % 23 = 0 THEN 'c' || {k} || '.square.site' "
            f"WHEN {k} % 10 IN (0, 2) THEN 'acme-roofing' || {k} || '.com' ELSE 'c' || {k} || '.example.com' END)")


def seo(title: str, website: str, opp: str, issues: str) -> str:
    return (f"{{'final_url': {website}, 'https_ok': true, 'status_code': 200, 'title': {title}, "
            f"'title_length': CAST(length({title}) AS INTEGER), 'description': CAST(NULL AS VARCHAR), "
            f"'description_length': 0, 'has_h1': false, 'has_og_title': false, 'has_og_image': false, "
            f"'has_favicon': false, 'word_count': 100, 'issues': {issues}, 'opportunity_score': CAST({opp} AS INTEGER)}}")


FX = f"""fx_leads0 AS (
  SELECT k AS id,
    CASE k % 10 WHEN 0 THEN 'Top 10 Plumbers in Austin' WHEN 1 THEN 'smithplumbing' WHEN 2 THEN 'Best Dentist'
                WHEN 3 THEN 'familydentalandair' ELSE c_name END AS name,
    d AS domain, 'https://' || d AS website,
    CASE WHEN k % 4 <> 0 THEN 'Customer of nation ' || c_nationkey END AS description,
    lower(c_mktsegment) AS query,
    list_filter({CH}, lambda x, i: floor(k / pow(2, i - 1)) % 2 = 1) AS channels,
    CASE WHEN k % 11 <> 0 THEN {{
      'emails': CASE WHEN k % 3 = 0 THEN ['info@c' || k || '.example.com'] ELSE {EMPTY} END,
      'phones': CASE WHEN k % 2 = 0 THEN ['(512) 555-' || {lpad4('k')}] ELSE {EMPTY} END,
      'socials': CASE WHEN k % 5 = 0 THEN ['https://linkedin.com/company/c' || k] ELSE {EMPTY} END,
      'contact_url': CASE WHEN k % 7 = 1 THEN 'https://' || d || '/contact' END,
      'people': CASE WHEN k % 7 = 0 THEN [{{'name': 'Owner ' || k, 'role': 'CEO'}}] ELSE {EMPTY_P} END}} END AS outreach,
    CASE WHEN k % 13 <> 0 THEN {seo('c_name', "'https://' || d", 'k % 101',
        "CASE WHEN k % 2 = 0 THEN ['Missing meta description'] ELSE ['Site not served over HTTPS', 'No favicon detected'] END")}
      END AS seo,
    CAST(floor(abs(c_acctbal)) % 101 AS INTEGER) AS score,
    ['seed ' || k] AS score_reasons,
    list_extract({ST}, CAST(k % 6 + 1 AS INTEGER)) AS status,
    CASE WHEN k % 3 = 1 THEN 'note ' || k END AS notes,
    CAST(k % 4 AS BIGINT) AS run_id,
    {ts(f"CASE WHEN k % 50 = 0 THEN {NOW_EPOCH} - (k % 9) * 86400 - (k % 3600) ELSE coalesce({ep('dmin')}, {FALLBACK_EPOCH}) + k % 86400 END")} AS created_at,
    {ts(f"coalesce({ep('dmax')}, {FALLBACK_EPOCH}) + k % 86400")} AS updated_at
  FROM (SELECT c_custkey AS k, *, {dom('c_custkey')} AS d FROM customer)
  LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS dmin, max(o_orderdate) AS dmax FROM orders GROUP BY 1)
    ON k = o_custkey),
fx_leads AS (
  SELECT *, coalesce(seo.opportunity_score, 0) AS opportunity_score, coalesce(len(seo.issues), 0) AS issues_count,
    coalesce(len(outreach.emails) > 0, false) AS has_email FROM fx_leads0),
fx_new_leads AS (
  SELECT 'New ' || c_name AS name, 'https://' || d AS website, d AS domain,
    CASE WHEN k % 8 <> 0 THEN 'fresh ' || k END AS description, 'q' || c_nationkey AS query,
    CASE WHEN k % 3 <> 0 THEN ['web', 'g2'] END AS channels,
    CASE WHEN k % 5 <> 0 THEN {{
      'emails': [' info@c' || k || '.example.com ', 'sales@c' || k || '.example.com'],
      'phones': ['(512) 555-' || {lpad4('k')}], 'socials': {EMPTY}, 'contact_url': 'https://x' || k || '/contact',
      'people': [{{'name': 'Owner ' || k, 'role': 'CTO'}}, {{'name': 'Staff ' || k, 'role': CAST(NULL AS VARCHAR)}}]}}
      END AS outreach,
    CASE WHEN k % 4 <> 2 THEN {seo('c_name', "'https://' || d", '(k * 7) % 101', "['Missing <title> tag']")} END AS seo,
    CAST(greatest(0, floor(abs(c_acctbal)) % 101 + (k % 3 - 1) * 5) AS INTEGER) AS score,
    ['new ' || k] AS score_reasons
  FROM (SELECT c_custkey AS k, *,
          CASE WHEN c_custkey % 2 = 0 THEN {dom('c_custkey')} ELSE 'new' || c_custkey || '.example.org' END AS d
        FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 7 = 3)),
fx_patches AS (
  SELECT id, status, notes, set_notes, patch_ord FROM (
    SELECT CASE WHEN k % 10 = 3 THEN k + 1000000 ELSE k END AS id,
      CASE k % 10 WHEN 0 THEN list_extract({ST}, CAST(floor(k / 10) % 6 + 1 AS INTEGER)) WHEN 2 THEN 'bogus'
                  WHEN 3 THEN 'won' WHEN 4 THEN 'qualified' END AS status,
      CASE WHEN k % 10 = 1 THEN '' END AS notes, k % 10 = 1 AS set_notes, k * 2 AS patch_ord
    FROM (SELECT c_custkey AS k FROM customer) WHERE k % 10 <= 5
    UNION ALL
    SELECT k, 'lost', NULL, false, k * 2 + 1 FROM (SELECT c_custkey AS k FROM customer) WHERE k % 10 = 4)),
fx_delete_ids AS (
  SELECT CAST(c_custkey AS DOUBLE) AS id FROM customer WHERE c_custkey % 10 = 7
  UNION ALL SELECT CAST(c_custkey AS DOUBLE) FROM customer WHERE c_custkey % 10 = 7
  UNION ALL SELECT CAST(c_custkey + 1000000 AS DOUBLE) FROM customer WHERE c_custkey % 10 = 8
  UNION ALL SELECT CAST(c_custkey AS DOUBLE) + 0.5 FROM customer WHERE c_custkey % 10 = 9),
fx_runs AS (
  SELECT id, {ts(f'{FALLBACK_EPOCH} + id * 86400')} AS started_at, {ts(f'{FALLBACK_EPOCH} + id * 86400 + 3600')} AS finished_at,
    CASE WHEN id % 5 = 0 THEN 'error' ELSE 'done' END AS status, CAST(n_regionkey + 1 AS INTEGER) AS search_count,
    CAST(id * 3 AS INTEGER) AS lead_count, id % 2 = 0 AS enrich, CASE WHEN id % 5 = 0 THEN 'boom ' || id END AS error
  FROM (SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_regionkey FROM nation))"""


def searches_ctes() -> str:
    from oracle import plansql as PL
    return f"""fx_specs AS ({PL.FX_SPECS}),
saved_specs AS ({PL.norm_specs('fx_specs', 'saved')}),
fx_searches AS (
  SELECT CAST(spec_ord + 1 AS BIGINT) AS id, niche, location, lim, channels,
    CASE WHEN spec_ord % 3 <> 0 THEN 'label ' || spec_ord END AS label, spec_ord % 4 <> 3 AS active,
    {ts(f'{FALLBACK_EPOCH} + (spec_ord % 5) * 3600')} AS created_at FROM saved_specs),
fx_new_searches AS (
  SELECT niche, location, 7 AS lim, CASE WHEN spec_ord % 4 = 0 THEN ['web'] ELSE {EMPTY} END AS channels,
    'new' AS label, CAST(spec_ord AS BIGINT) AS input_ord FROM saved_specs WHERE spec_ord % 2 = 0
  UNION ALL
  SELECT niche || ' pro', location, CAST(NULL AS INTEGER), CAST(NULL AS VARCHAR[]), CAST(NULL AS VARCHAR),
    CAST(spec_ord + 100 AS BIGINT) FROM saved_specs WHERE spec_ord % 3 = 1)"""


W = "WITH " + FX
WS_ = "WITH " + FX + ", " + searches_ctes()


def merge_outreach(prev: str, nxt: str) -> str:
    def u(f):
        return clean_distinct(f"list_concat(coalesce({prev}.{f}, {EMPTY}), coalesce({nxt}.{f}, {EMPTY}))")
    named = (f"list_filter(list_concat(coalesce({prev}.people, {EMPTY_P}), coalesce({nxt}.people, {EMPTY_P})), "
             f"lambda p: coalesce(p.name, '') <> '')")
    names = odistinct(f"list_transform({named}, lambda p: p.name)")
    people = f"list_transform({names}, lambda nm: list_extract(list_filter({named}, lambda p: p.name = nm), -1))"
    both = (f"{{'emails': {u('emails')}, 'phones': {u('phones')}, 'socials': {u('socials')}, "
            f"'contact_url': coalesce({prev}.contact_url, {nxt}.contact_url), 'people': {people}}}")
    return f"(CASE WHEN {prev} IS NULL THEN {nxt} WHEN {nxt} IS NULL THEN {prev} ELSE {both} END)"


def people_str(o: str) -> str:
    return f"array_to_string(list_transform({o}.people, lambda p: concat_ws('/', p.name, p.role)), '; ')"


def lead_rows(t: str) -> str:
    return f"""SELECT id, name, domain, website, description, query, array_to_string(channels, '; ') AS channels,
  array_to_string(outreach.emails, '; ') AS emails, array_to_string(outreach.phones, '; ') AS phones,
  array_to_string(outreach.socials, '; ') AS socials, outreach.contact_url AS contact_url,
  {people_str('outreach')} AS people, CAST(seo.opportunity_score AS BIGINT) AS seo_opportunity,
  CAST(score AS BIGINT) AS score, CAST(opportunity_score AS BIGINT) AS opportunity_score,
  CAST(issues_count AS BIGINT) AS issues_count, has_email, array_to_string(score_reasons, '; ') AS reasons,
  status, notes, run_id, {tstr('created_at')} AS created_at, {tstr('updated_at')} AS updated_at FROM {t}"""


Q["merge_outreach"] = f"""{W},
m AS (SELECT coalesce(o.domain, n.domain) AS domain, {merge_outreach('o.outreach', 'n.outreach')} AS m
      FROM fx_leads o FULL OUTER JOIN fx_new_leads n ON o.domain = n.domain)
SELECT domain, m IS NOT NULL AS present, array_to_string(m.emails, '; ') AS emails,
  array_to_string(m.phones, '; ') AS phones, array_to_string(m.socials, '; ') AS socials,
  m.contact_url AS contact_url, {people_str('m')} AS people FROM m"""

Q["upsert_leads"] = f"""{W},
j AS (SELECT o.id AS o_id, o.name AS o_name, o.domain AS o_domain, o.description AS o_description,
        o.outreach AS o_outreach, o.seo AS o_seo, o.score AS o_score, o.score_reasons AS o_reasons,
        o.status AS o_status, o.notes AS o_notes, o.created_at AS o_created, o.updated_at AS o_updated,
        o.website AS o_website, o.query AS o_query, o.channels AS o_channels, o.opportunity_score AS o_opp,
        o.issues_count AS o_ic, o.has_email AS o_he, o.run_id AS o_run,
        n.name AS n_name, n.domain AS n_domain, n.website AS n_website, n.description AS n_description,
        n.query AS n_query, n.channels AS n_channels, n.outreach AS n_outreach, n.seo AS n_seo,
        n.score AS n_score, n.score_reasons AS n_reasons
      FROM fx_leads o FULL OUTER JOIN fx_new_leads n ON o.domain = n.domain),
c AS (SELECT *, {merge_outreach('o_outreach', 'n_outreach')} AS m_out, coalesce(n_seo, o_seo) AS m_seo,
        greatest(n_score, coalesce(o_score, 0)) AS m_score FROM j),
u AS (
  SELECT o_id AS id, n_name AS name, o_domain AS domain, n_website AS website,
    coalesce(n_description, o_description) AS description, n_query AS query, coalesce(n_channels, {EMPTY}) AS channels,
    m_out AS outreach, m_seo AS seo, m_score AS score,
    coalesce(m_seo.opportunity_score, 0) AS opportunity_score, coalesce(len(m_seo.issues), 0) AS issues_count,
    coalesce(len(m_out.emails) > 0, false) AS has_email,
    CASE WHEN m_score = n_score THEN n_reasons ELSE coalesce(o_reasons, n_reasons) END AS score_reasons,
    o_status AS status, o_notes AS notes, CAST(9 AS BIGINT) AS run_id, o_created AS created_at, {NOW} AS updated_at
  FROM c WHERE o_id IS NOT NULL AND n_domain IS NOT NULL
  UNION ALL
  SELECT o_id, o_name, o_domain, o_website, o_description, o_query, o_channels, o_outreach, o_seo, o_score,
    o_opp, o_ic, o_he, o_reasons, o_status, o_notes, o_run, o_created, o_updated
  FROM c WHERE n_domain IS NULL
  UNION ALL
  SELECT (SELECT coalesce(max(id), 0) FROM fx_leads) + row_number() OVER (ORDER BY n_domain), n_name, n_domain,
    n_website, n_description, n_query, coalesce(n_channels, {EMPTY}), m_out, m_seo, m_score,
    coalesce(m_seo.opportunity_score, 0), coalesce(len(m_seo.issues), 0), coalesce(len(m_out.emails) > 0, false),
    CASE WHEN m_score = n_score THEN n_reasons ELSE coalesce(o_reasons, n_reasons) END,
    'new', NULL, 9, {NOW}, {NOW}
  FROM c WHERE o_id IS NULL)
{lead_rows('u')}"""

Q["known_domains"] = f"{W} SELECT DISTINCT domain FROM fx_leads"

_PATCH = f"""p AS (SELECT * FROM fx_patches WHERE status IS NULL OR list_contains({ST}, status)),
lastp AS (SELECT id, {{'status': arg_max(status, patch_ord) FILTER (status IS NOT NULL),
            'notes': (arg_max({{'n': notes}}, patch_ord) FILTER (set_notes)).n, 'set_notes': bool_or(set_notes)}} AS p
          FROM p GROUP BY id)"""

Q["patch_leads"] = f"""{W}, {_PATCH}
SELECT l.id, CASE WHEN lp.p IS NOT NULL AND lp.p.status IS NOT NULL THEN lp.p.status ELSE l.status END AS status,
  CASE WHEN lp.p IS NOT NULL AND lp.p.set_notes THEN lp.p.notes ELSE l.notes END AS notes,
  CASE WHEN lp.p IS NOT NULL THEN '1999-06-15 12:00:00' ELSE {tstr('l.updated_at')} END AS updated_at
FROM fx_leads l LEFT JOIN lastp lp USING (id)"""

Q["patch_leads_rejected"] = f"""{W}
SELECT id, status FROM fx_patches WHERE NOT (status IS NULL OR list_contains({ST}, status))"""

_GOOD = "good AS (SELECT DISTINCT CAST(id AS BIGINT) AS id FROM fx_delete_ids WHERE id IS NOT NULL AND id = floor(id))"

Q["delete_leads"] = f"""{W}, {_GOOD}
SELECT id, domain FROM fx_leads WHERE id NOT IN (SELECT id FROM good)"""

Q["delete_leads_count"] = f"""{W}, {_GOOD}
SELECT count(*) AS deleted FROM fx_leads WHERE id IN (SELECT id FROM good)"""

_CLEAN = f"""cl AS (
  SELECT *, CASE WHEN {NS.listicle('name')} THEN {NS.clean_name('domain')}
                 WHEN NOT regexp_matches(name, {lit(WS)}) AND length(name) > 9 AND regexp_matches(name, '^[A-Za-z]+\\z')
                 THEN {NS.clean_name('lower(name)')} END AS clean
  FROM fx_leads WHERE NOT {NS.is_microsite('domain')}),
cr AS (SELECT *, coalesce(clean IS NOT NULL AND lower(clean) <> lower(name)
                          AND (contains(clean, ' ') OR {NS.listicle('name')}), false) AS ren FROM cl)"""

Q["cleanup_leads"] = f"""{W}, {_CLEAN}
SELECT id, CASE WHEN ren THEN clean ELSE name END AS name,
  CASE WHEN ren THEN '1999-06-15 12:00:00' ELSE {tstr('updated_at')} END AS updated_at FROM cr"""

Q["cleanup_deleted"] = f"""{W} SELECT name, domain FROM fx_leads WHERE {NS.is_microsite('domain')}"""

Q["cleanup_renamed"] = f"""{W}, {_CLEAN} SELECT name AS "from", clean AS "to" FROM cr WHERE ren"""

_SROWS = """SELECT id, niche, location, CAST(lim AS BIGINT) AS lim, array_to_string(channels, '; ') AS channels,
  label, active, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM"""

Q["upsert_searches"] = f"""{WS_},
n AS (SELECT niche, coalesce(location, '') AS k,
        arg_max({{'location': location, 'lim': lim, 'channels': channels, 'label': label, 'input_ord': input_ord}},
                input_ord) AS r, min(input_ord) AS first_ord
      FROM fx_new_searches GROUP BY niche, coalesce(location, '')),
s AS (SELECT *, coalesce(location, '') AS k FROM fx_searches),
j AS (SELECT coalesce(s.niche, n.niche) AS niche, s.id, s.location, s.lim, s.channels, s.label, s.active,
        s.created_at, n.r, n.first_ord FROM s FULL OUTER JOIN n ON s.niche = n.niche AND s.k = n.k),
out AS (
  SELECT id, niche, location,
    CASE WHEN r IS NOT NULL THEN CAST(coalesce(r.lim, 10) AS INTEGER) ELSE lim END AS lim,
    CASE WHEN r IS NOT NULL THEN (CASE WHEN len(r.channels) > 0 THEN r.channels END) ELSE channels END AS channels,
    CASE WHEN r IS NOT NULL THEN r.label ELSE label END AS label,
    CASE WHEN r IS NOT NULL THEN true ELSE active END AS active, created_at
  FROM j WHERE id IS NOT NULL
  UNION ALL
  SELECT (SELECT coalesce(max(id), 0) FROM fx_searches) + row_number() OVER (ORDER BY first_ord), niche, r.location,
    CAST(coalesce(r.lim, 10) AS INTEGER), CASE WHEN len(r.channels) > 0 THEN r.channels END, r.label, true, {NOW}
  FROM j WHERE id IS NULL)
{_SROWS} out"""

Q["set_search_active"] = f"""{WS_}
SELECT id, CASE WHEN id % 3 = 0 THEN false ELSE active END AS active FROM fx_searches"""

Q["delete_searches"] = f"""{WS_} SELECT id FROM fx_searches WHERE id % 4 <> 1"""

Q["list_searches"] = f"""{WS_}
SELECT id, {tstr('created_at')} AS created_at FROM fx_searches WHERE active ORDER BY created_at DESC, id"""

Q["start_finish_run"] = f"""{W},
r AS (SELECT * FROM fx_runs UNION ALL
      SELECT (SELECT max(id) + 1 FROM fx_runs), {NOW}, NULL, 'running', 4, 0, true, NULL)
SELECT id, {tstr('started_at')} AS started_at,
  CASE WHEN id = (SELECT max(id) FROM r) THEN '1999-06-15 12:05:00' WHEN id = 5 THEN '1999-06-15 12:06:00'
       ELSE {tstr('finished_at')} END AS finished_at,
  CASE WHEN id = (SELECT max(id) FROM r) THEN 'done' WHEN id = 5 THEN 'error' ELSE status END AS status,
  CAST(search_count AS BIGINT) AS search_count,
  CAST(CASE WHEN id = (SELECT max(id) FROM r) THEN 42 WHEN id = 5 THEN 1 ELSE lead_count END AS BIGINT) AS lead_count,
  enrich, CASE WHEN id = (SELECT max(id) FROM r) THEN NULL WHEN id = 5 THEN 'failed again' ELSE error END AS error
FROM r"""

Q["list_runs"] = f"""{W} SELECT id, status FROM fx_runs ORDER BY id DESC LIMIT 10"""

# ------------------------------------------------------------------ views

Q["filter_status"] = f"{W} SELECT id FROM fx_leads WHERE status = 'qualified'"
Q["filter_min_score"] = f"{W} SELECT id FROM fx_leads WHERE score >= 70"
Q["filter_has_email"] = f"{W} SELECT id FROM fx_leads WHERE has_email"
Q["filter_text"] = f"{W} SELECT id FROM fx_leads WHERE contains(lower(name), 'plumb') OR contains(lower(domain), 'plumb')"
Q["filter_channel"] = f"{W} SELECT id FROM fx_leads WHERE list_contains(channels, 'g2')"


def period(p: str, tz: str = "UTC") -> str:
    c = "created_at"
    if p == "today":
        return f"CAST(timezone('{tz}', CAST({c} AS TIMESTAMPTZ)) AS DATE) = CAST(timezone('{tz}', CAST({NOW} AS TIMESTAMPTZ)) AS DATE)"
    if p == "yesterday":
        return f"CAST(timezone('{tz}', CAST({c} AS TIMESTAMPTZ)) AS DATE) = CAST(timezone('{tz}', CAST({NOW} AS TIMESTAMPTZ)) AS DATE) - 1"
    if p == "week":
        return f"date_diff('microsecond', {c}, {NOW}) <= 604800000000"
    if p == "month":
        return f"year({c}) = year({NOW}) AND month({c}) = month({NOW})"
    return f"year({c}) = year({NOW})"


Q["filter_period"] = W + " " + " UNION ALL ".join(
    [f"SELECT '{p}' AS period, id FROM fx_leads WHERE {period(p)}" for p in ("today", "yesterday", "week", "month", "year")]
    + [f"SELECT 'today_chicago', id FROM fx_leads WHERE {period('today', 'America/Chicago')}"])

Q["filter_date_range"] = f"""{W} SELECT id FROM fx_leads
WHERE strftime(created_at, '%Y-%m-%d') >= '1996-01-01' AND strftime(created_at, '%Y-%m-%d') <= '1996-12-31'"""

Q["list_leads"] = f"""{W}
SELECT id, CAST(opportunity_score AS BIGINT) AS opportunity_score
FROM fx_leads WHERE score >= 20 AND list_contains(channels, 'web') ORDER BY opportunity_score DESC, id"""

Q["list_leads_recent"] = f"""{W}
SELECT id, {tstr('updated_at')} AS updated_at FROM fx_leads WHERE status = 'new' ORDER BY updated_at DESC, id"""

Q["list_leads_name"] = f"""{W}
SELECT id, name FROM fx_leads WHERE (contains(lower(name), 'c') OR contains(lower(domain), 'c')) AND {period('year')}"""

Q["top_leads"] = f"{W} SELECT id, CAST(score AS BIGINT) AS score FROM fx_leads ORDER BY score DESC, id LIMIT 6"

Q["lead_stats"] = f"""{WS_}
SELECT (SELECT count(*) FROM fx_leads) AS total_leads,
  CAST(coalesce(round((SELECT avg(score) FROM fx_leads)), 0) AS BIGINT) AS avg_score,
  (SELECT count(*) FROM fx_leads WHERE score >= 70) AS hot_leads,
  (SELECT count(*) FROM fx_leads WHERE has_email) AS with_email,
  (SELECT count(*) FROM fx_searches WHERE active) AS active_searches,
  (SELECT count(*) FROM fx_runs) AS total_runs,
  (SELECT {tstr('arg_max(started_at, id)')} FROM fx_runs) AS last_run_at"""

Q["status_counts"] = f"""{W}
SELECT status, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT status, count(*) AS n FROM fx_leads GROUP BY 1)"""

Q["filtered_summary"] = f"""{W}
SELECT count(*) AS total, count(*) FILTER (WHERE has_email) AS with_email, count(*) FILTER (WHERE score >= 70) AS hot,
  CAST(coalesce(round(avg(score)), 0) AS BIGINT) AS avg,
  CAST(CASE WHEN count(*) > 0 THEN round(count(*) FILTER (WHERE has_email) / count(*) * 100) END AS BIGINT) AS pct_with_email
FROM fx_leads WHERE list_contains(channels, 'linkedin')"""

_J = "coalesce(array_to_string({}, '; '), '')"
Q["export_view"] = f"""{W}
SELECT name AS business, website, CAST(score AS VARCHAR) AS score, CAST(opportunity_score AS VARCHAR) AS seo_opportunity,
  status, {_J.format('channels')} AS channels, {_J.format('outreach.emails')} AS emails,
  {_J.format('outreach.phones')} AS phones, {_J.format('outreach.socials')} AS socials,
  coalesce(outreach.contact_url, '') AS contact_page,
  {_J.format("list_transform(outreach.people, lambda p: CASE WHEN coalesce(p.role, '') <> '' THEN p.name || ' (' || p.role || ')' ELSE p.name END)")} AS people,
  {_J.format('seo.issues')} AS seo_issues, coalesce(query, '') AS search, coalesce(notes, '') AS notes,
  {tstr('updated_at')} AS updated_at
FROM fx_leads WHERE score >= 10"""

Q["primary_contact"] = f"""{W}
SELECT id, list_extract(outreach.emails, 1) AS email, list_extract(outreach.phones, 1) AS phone FROM fx_leads"""


def enc(e: str) -> str:
    """encodeURIComponent over UTF-8 bytes."""
    chars = f"string_split({e}, '')"
    one = ("CASE WHEN regexp_matches(ch, '^[A-Za-z0-9_.!~*''()-]$') THEN ch "
           "ELSE regexp_replace(upper(hex(encode(ch))), '(..)', '%\\1', 'g') END")
    return f"array_to_string(list_transform({chars}, lambda ch: {one}), '')"


_LINKS = "[" + ", ".join(f"{{'channel': {lit(c)}, 'prefix': {lit(u)}}}" for c, _, u in K.CHANNEL_SEARCH_URLS) + "]"

Q["research_links"] = f"""{W},
ln AS (SELECT unnest({_LINKS}, recursive := true)),
per AS (SELECT id, query, unnest(channels) AS channel, generate_subscripts(channels, 1) - 1 AS pos
        FROM fx_leads WHERE query IS NOT NULL)
SELECT id, CAST(pos AS BIGINT) AS pos, channel, prefix || {enc('query')} AS link FROM per JOIN ln USING (channel)
UNION ALL
SELECT id, -1, 'lookup', {lit(K.LOOKUP_URL)} || {enc("name || ' ' || domain")} FROM fx_leads"""

Q["audit_checklist"] = f"""{W},
a AS (SELECT id, seo FROM fx_leads WHERE seo IS NOT NULL)
SELECT id, CAST(pos AS BIGINT) AS pos, label, ok FROM (
  SELECT id, 1 AS pos, 'HTTPS' AS label, coalesce(seo.https_ok, false) AS ok FROM a
  UNION ALL SELECT id, 2, 'Title' || CASE WHEN coalesce(seo.title_length, 0) <> 0 THEN ' (' || seo.title_length || ' chars)' ELSE '' END, seo.title IS NOT NULL FROM a
  UNION ALL SELECT id, 3, 'Meta description' || CASE WHEN coalesce(seo.description_length, 0) <> 0 THEN ' (' || seo.description_length || ')' ELSE '' END, seo.description IS NOT NULL FROM a
  UNION ALL SELECT id, 4, 'H1 heading', coalesce(seo.has_h1, false) FROM a
  UNION ALL SELECT id, 5, 'Open Graph title', coalesce(seo.has_og_title, false) FROM a
  UNION ALL SELECT id, 6, 'Open Graph image', coalesce(seo.has_og_image, false) FROM a
  UNION ALL SELECT id, 7, 'Favicon', coalesce(seo.has_favicon, false) FROM a)"""
