"""Oracle SQL per job name. Column names equal the Spark jobs' columns."""

from __future__ import annotations

from oracle import pagesql as PS
from oracle.fixtures_sql import RICH_PAGES
from oracle.sqlkit import join

ORACLE: dict[str, str] = {}

PAGES = "SELECT page_id, url, html, CAST(200 AS INTEGER) AS status_code FROM pages"


def _sig(src_sql: str) -> str:
    return f"WITH src AS ({src_sql}), {PS.signals_cte('src', 'page_id')}"


ORACLE["score_pages"] = f"""{_sig(PAGES)},
c AS (SELECT *, {PS.emails('text')} AS emails, {PS.phones('text')} AS phones,
             {PS.socials('external')} AS socials FROM sig),
a AS ({PS.audit_cte('c')}),
s AS (SELECT *, {PS.score_cols('true', 'opportunity_score', 'len(issues)', 'status_code', 'true',
                               'len(emails)', 'len(phones)', 'len(socials)', '0')} FROM a)
SELECT page_id, url, CAST(score AS BIGINT) AS score, CAST(opportunity_score AS BIGINT) AS opportunity_score,
  CAST(len(issues) AS BIGINT) AS issues_count, {join('issues')} AS issues, {join('reasons')} AS reasons,
  {join('emails')} AS emails, {join('phones')} AS phones, {join('socials')} AS socials
FROM s ORDER BY score DESC, page_id
"""

ORACLE["html_to_text"] = f"""
SELECT page_id, md5(t) AS text_md5, CAST(length(t) AS BIGINT) AS text_chars
FROM (SELECT page_id, {PS.html_to_text('html')} AS t FROM pages)
"""

ORACLE["extract_title"] = f"""
SELECT page_id, {PS.title('html')} AS title FROM (
  SELECT page_id, html FROM pages
  UNION ALL SELECT page_id + 1000000, html FROM ({RICH_PAGES}))
"""

ORACLE["page_metadata"] = f"""{_sig(RICH_PAGES)}
SELECT page_id, final_url, CAST(status_code AS BIGINT) AS status_code, title, description,
  og_title, og_description, og_image, favicon FROM sig
"""

ORACLE["extract_links"] = f"""WITH src AS (
  SELECT page_id, url, html FROM ({RICH_PAGES})
  UNION ALL SELECT page_id + 1000000, url, html FROM pages),
{PS.links_ctes('src', 'page_id')}
SELECT page_id, {join('internal')} AS internal, {join('external')} AS external,
  CAST(len(internal) AS BIGINT) AS n_internal, CAST(len(external) AS BIGINT) AS n_external FROM lk
"""

ORACLE["extract_emails"] = f"""
SELECT doc_id, {join('e')} AS emails, CAST(len(e) AS BIGINT) AS n_emails
FROM (SELECT doc_id, {PS.emails('text')} AS e FROM documents)
"""

ORACLE["extract_phones"] = f"""
SELECT doc_id, {join('e')} AS phones, CAST(len(e) AS BIGINT) AS n_phones
FROM (SELECT doc_id, {PS.phones('text')} AS e FROM documents)
"""

_SOC_HOST = ("list_filter(coalesce(external, []), lambda l: "
             + " OR ".join(f"(h(l) = '{d}' OR ends_with(h(l), '.{d}'))" for d in PS.K.SOCIAL_DOMAINS) + ")")
_H = "lower(regexp_extract(l, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"

ORACLE["extract_socials"] = f"""{_sig(RICH_PAGES)}
SELECT page_id, {join(PS.socials('external'))} AS socials,
  {join(PS.clean_distinct(_SOC_HOST.replace('h(l)', _H)))} AS socials_host FROM sig
"""

ORACLE["word_count"] = f"""
SELECT doc_id, CAST({PS.word_count('text')} AS BIGINT) AS words FROM documents
"""

_AUDIT_OUT = """page_id, a_final_url AS final_url, https_ok, CAST(status_code AS BIGINT) AS status_code,
  a_title AS title, CAST(title_length AS BIGINT) AS title_length, a_description AS description,
  CAST(description_length AS BIGINT) AS description_length, has_h1, has_og_title, has_og_image, has_favicon,
  CAST(words AS BIGINT) AS word_count, array_to_string(issues, '; ') AS issues,
  CAST(opportunity_score AS BIGINT) AS opportunity_score"""

ORACLE["audit_seo"] = f"""{_sig(RICH_PAGES)}, a AS ({PS.audit_cte('sig')})
SELECT {_AUDIT_OUT} FROM a
"""

ORACLE["score_lead"] = f"""{_sig(RICH_PAGES)},
c AS (SELECT *, {PS.emails('text')} AS emails, {PS.phones('text')} AS phones,
             {PS.socials('external')} AS socials FROM sig),
a AS ({PS.audit_cte('c')}),
s AS (SELECT *, {PS.score_cols('true', 'opportunity_score', 'len(issues)', 'status_code', 'true',
                               'len(emails)', 'len(phones)', 'len(socials)', '0')} FROM a)
SELECT page_id, CAST(score AS BIGINT) AS score, {join('reasons')} AS reasons FROM s
"""

ORACLE["scrape_report"] = f"""{_sig(RICH_PAGES)},
c AS (SELECT *, {PS.emails('text')} AS emails, {PS.phones('text')} AS phones,
             {PS.socials('external')} AS socials FROM sig)
SELECT page_id, url, CAST(status_code AS BIGINT) AS status_code,
  CAST(len(internal) AS BIGINT) AS internal_links, CAST(len(external) AS BIGINT) AS external_links,
  {join('emails')} AS emails, {join('phones')} AS phones, {join('socials')} AS socials,
  title, description, og_title, og_image IS NOT NULL AS has_og_image, favicon IS NOT NULL AS has_favicon,
  coalesce(regexp_matches(text, {PS.lit('(?:^|' + chr(10) + ')#' + PS.WS + '+' + PS.NWS)}), false) AS has_h1,
  CAST(length(text) AS BIGINT) AS text_length
FROM c
"""

ORACLE["successful_pages"] = f"""
SELECT page_id, coalesce(status_code BETWEEN 200 AND 299, false) AS success,
  CASE WHEN coalesce(status_code BETWEEN 200 AND 299, false) THEN NULL
       WHEN status_code IS NULL THEN 'fetch failed' ELSE 'HTTP ' || status_code END AS error
FROM ({RICH_PAGES})
"""


from oracle.discsql import Q as _DISCOVERY  # noqa: E402

ORACLE.update(_DISCOVERY)

ORACLE["score_band"] = f"""{_sig(PAGES)},
c AS (SELECT *, {PS.emails('text')} AS emails, {PS.phones('text')} AS phones,
             {PS.socials('external')} AS socials FROM sig),
a AS ({PS.audit_cte('c')}),
s AS (SELECT *, {PS.score_cols('true', 'opportunity_score', 'len(issues)', 'status_code', 'true',
                               'len(emails)', 'len(phones)', 'len(socials)', '0')} FROM a)
SELECT page_id, CAST(score AS BIGINT) AS score,
  CASE WHEN score >= 70 THEN 'hot' WHEN score >= 40 THEN 'warm' ELSE 'cold' END AS band FROM s
"""

from oracle.storesql import Q as _STORE  # noqa: E402

ORACLE.update(_STORE)

# ------------------------------------------------------------------ sources, sinks, streams

from leadlake import constants as _K  # noqa: E402
from oracle import discsql as _D  # noqa: E402
from oracle import namesql as _NS  # noqa: E402
from oracle import storesql as _S  # noqa: E402
from oracle.sqlkit import lit as _lit  # noqa: E402

ORACLE["read_pages"] = """
SELECT page_id, url, md5(html) AS html_md5, CAST(length(html) AS BIGINT) AS html_chars FROM pages"""

ORACLE["read_serp"] = f"""{_D.FIX}
SELECT CAST(provider_ord AS BIGINT) AS provider_ord, query, CAST(rank AS BIGINT) AS rank, url, title,
  CASE WHEN rank % 5 = 0 THEN '' ELSE description END AS description FROM serp"""

ORACLE["read_places"] = f"""{_D.FIX}
SELECT query, CAST(page_no AS BIGINT) AS page_no, CAST(pos AS BIGINT) AS pos, name_text, website_uri,
  national_phone, rating FROM places WHERE page_no < 3"""

ORACLE["load_store"] = f"""{_S.W} {_S.lead_rows('fx_leads')}"""

ORACLE["load_store_searches"] = f"""{_S.WS_} {_S._SROWS} fx_searches"""

ORACLE["save_table"] = f"""{_S.W} SELECT id, domain FROM fx_leads"""

ORACLE["export_leads_csv"] = _S.Q["export_view"]

ORACLE["exclude_blocked"] = f"""{_D.FIX}, {_D.HITS_HOSTS}
SELECT DISTINCT host FROM hh WHERE host IS NOT NULL AND NOT {_NS.is_blocked('host')}"""

ORACLE["stream_enrich"] = ORACLE["score_pages"]

ORACLE["stream_new_domains"] = f"""{_D.FIX}, {_D.HITS_HOSTS}
SELECT DISTINCT host AS domain FROM hh WHERE host IS NOT NULL AND NOT {_NS.is_blocked('host')}
  AND host NOT IN (SELECT domain FROM known WHERE domain IS NOT NULL)"""

ORACLE["stream_upsert"] = _S.Q["upsert_leads"]

from oracle.analysissql import Q as _ANALYSIS  # noqa: E402

ORACLE.update(_ANALYSIS)
