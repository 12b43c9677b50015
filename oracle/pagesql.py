"""DuckDB SQL for page signals, links, contacts, audit and score."""

from __future__ import annotations

from leadlake import constants as K
from oracle.sqlkit import NWS, WS, blank_null, clean_distinct, lit, odistinct, re2, trim_js

ABS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*([^/\\?]*)([^?]*)(\?.*)?\z"
AUTH = r"^(?:.*@)?([^:]*)(?::(.*))?\z"
BAD_HOST = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"
ANCHOR = r"""(?i)<a[^>]+href=["']([^"'#]+)["']"""


def strip_href(e: str) -> str:
    s = f"regexp_replace({e}, {lit(r'^[\x00-\x20]+|[\x00-\x20]+\z')}, '', 'g')"
    return f"regexp_replace({s}, {lit(r'[\t\n\r]')}, '', 'g')"


def clean_url(e: str) -> str:
    return f"regexp_replace({strip_href(e)}, {lit(r'(?s)#.*\z')}, '')"


def parts_cols(u: str, prefix: str) -> str:
    """Columns <prefix>scheme/host/port/path/query/ok of an absolute URL expression."""
    auth = f"regexp_extract({u}, {lit(ABS)}, 2)"
    host = f"lower(regexp_extract({auth}, {lit(AUTH)}, 1))"
    port = f"regexp_extract({auth}, {lit(AUTH)}, 2)"
    scheme = f"lower(regexp_extract({u}, {lit(ABS)}, 1))"
    path = f"replace(regexp_extract({u}, {lit(ABS)}, 3), '\\', '/')"
    query = f"regexp_extract({u}, {lit(ABS)}, 4)"
    ok = (f"(regexp_matches({u}, {lit(ABS)}) AND {scheme} <> '' AND {host} <> '' "
          f"AND NOT regexp_matches({host}, {lit(BAD_HOST)}) AND regexp_matches({port}, {lit(r'^[0-9]{0,5}\z')}))")
    return (f"{scheme} AS {prefix}scheme, {host} AS {prefix}host, {port} AS {prefix}port, "
            f"{path} AS {prefix}path, {query} AS {prefix}query, {ok} AS {prefix}ok")


def port_suffix(scheme: str, port: str) -> str:
    return (f"(CASE WHEN {port} = '' OR ({scheme} = 'http' AND {port} = '80') OR ({scheme} = 'https' AND {port} = '443') "
            f"THEN '' ELSE ':' || CAST(CAST({port} AS INTEGER) AS VARCHAR) END)")


def remove_dots(p: str) -> str:
    segs = f"string_split({p}, '/')"
    red = (f"list_reduce({segs}, lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*\\z', '') "
           f"WHEN x = '.' THEN acc ELSE acc || '/' || x END)")
    trailing = f"(CASE WHEN list_extract({segs}, -1) IN ('.', '..') AND {red} <> '' THEN '/' ELSE '' END)"
    full = f"(CASE WHEN {red} = '' THEN '/' ELSE {red} || {trailing} END)"
    return f"(CASE WHEN regexp_matches({p}, {lit(r'(^|/)\.\.?(/|\z)')}) THEN {full} ELSE {p} END)"


def encode_path(e: str) -> str:
    for ch, enc in ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"), ("{", "%7B"), ("}", "%7D")):
        e = f"replace({e}, {lit(ch)}, {lit(enc)})"
    return e


def encode_query(e: str) -> str:
    for ch, enc in ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("'", "%27")):
        e = f"replace({e}, {lit(ch)}, {lit(enc)})"
    return e


def links_ctes(src: str, key: str) -> str:
    """CTEs ``lk_base``, ``lk_raw``, ``lk_cand``, ``lk_res``, ``lk_agg`` over ``src``
    (needs columns ``key``, url, html). ``lk_agg`` has key, internal, external."""
    q = r"(?s)(\?.*)\z"
    return f"""
lk_base AS (
  SELECT {key}, {parts_cols(clean_url('url'), 'b_')} FROM {src}
),
lk_raw AS (
  SELECT {key}, unnest(h) AS href, generate_subscripts(h, 1) AS ord
  FROM (SELECT {key}, regexp_extract_all(html, {lit(ANCHOR)}, 1) AS h FROM {src})
),
lk_h AS (
  SELECT r.{key}, r.ord, {strip_href('r.href')} AS h, b.* EXCLUDE ({key})
  FROM lk_raw r JOIN lk_base b USING ({key})
),
lk_cand AS (
  SELECT *,
    CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN 'abs'
         WHEN regexp_matches(h, '^[/\\\\]{{2}}') THEN 'net'
         ELSE 'rel' END AS kind,
    CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {clean_url('h')}
         WHEN regexp_matches(h, '^[/\\\\]{{2}}') THEN {clean_url("b_scheme || ':' || h")} END AS absu,
    replace(CASE WHEN regexp_matches(h, '^[/\\\\]') THEN regexp_extract(h, '^([^?]*)', 1)
         WHEN starts_with(h, '?') THEN b_path
         ELSE coalesce(nullif(regexp_extract(b_path, '^(.*/)', 1), ''), '/') || regexp_extract(h, '^([^?]*)', 1)
    END, '\\', '/') AS rel_path,
    regexp_extract(h, {lit(q)}, 1) AS rel_query
  FROM lk_h
),
lk_parsed AS (
  SELECT {key}, ord, b_host, b_ok, kind, rel_path, rel_query, b_scheme, b_port, {parts_cols('absu', 'a_')}
  FROM lk_cand
),
lk_res AS (
  SELECT {key}, ord, b_host,
    CASE WHEN kind = 'rel' THEN b_ok ELSE a_ok END AS ok,
    CASE WHEN kind = 'rel' THEN b_scheme ELSE a_scheme END AS scheme,
    CASE WHEN kind = 'rel' THEN b_host ELSE a_host END AS host,
    CASE WHEN kind = 'rel' THEN b_port ELSE a_port END AS port,
    CASE WHEN kind = 'rel' THEN rel_path ELSE a_path END AS path,
    CASE WHEN kind = 'rel' THEN rel_query ELSE a_query END AS query
  FROM lk_parsed
),
lk_url AS (
  SELECT {key}, ord, host, b_host,
    scheme || '://' || host || {port_suffix('scheme', 'port')}
      || {encode_path(remove_dots("CASE WHEN path = '' THEN '/' ELSE path END"))} || {encode_query('query')} AS url
  FROM lk_res WHERE ok AND scheme IN ('http', 'https')
),
lk_agg AS (
  SELECT b.{key},
    coalesce(list(u.url ORDER BY u.ord) FILTER (WHERE u.host = u.b_host), []) AS internal_all,
    coalesce(list(u.url ORDER BY u.ord) FILTER (WHERE u.host IS DISTINCT FROM u.b_host), []) AS external_all
  FROM lk_base b LEFT JOIN lk_url u USING ({key})
  GROUP BY b.{key}
),
lk AS (
  SELECT {key}, {odistinct('internal_all')} AS internal, {odistinct('external_all')} AS external FROM lk_agg
)"""


def html_to_text(e: str) -> str:
    t = f"regexp_replace({e}, '(?is)<script.*?</script>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<style.*?</style>', ' ', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    t = f"regexp_replace({t}, {lit(WS + '+')}, ' ', 'g')"
    return trim_js(t)


def meta(e: str, key: str) -> str:
    pat = (r"""(?i)<meta[^>]+(?:name|property)=["']""" + key
           + r"""["'][^>]+content=["']([^"']+)["']|<meta[^>]+content=["']([^"']+)["'][^>]+(?:name|property)=["']"""
           + key + r"""["']""")
    g1 = f"regexp_extract({e}, {lit(pat)}, 1)"
    g2 = f"regexp_extract({e}, {lit(pat)}, 2)"
    return blank_null(f"(CASE WHEN {g1} <> '' THEN {g1} ELSE {g2} END)")


def title(e: str) -> str:
    return blank_null(f"regexp_extract({e}, '(?i)<title[^>]*>([^<]*)</title>', 1)")


def signals_cte(src: str, key: str, status: str = "status_code") -> str:
    """CTE ``sig`` over ``src`` (key, url, html[, status]) + link CTEs."""
    return f"""{links_ctes(src, key)},
sig AS (
  SELECT s.{key}, s.url, CAST({status} AS INTEGER) AS status_code, s.url AS final_url,
    {title('s.html')} AS title,
    {meta('s.html', 'description')} AS description,
    {meta('s.html', 'og:title')} AS og_title,
    {meta('s.html', 'og:description')} AS og_description,
    {meta('s.html', 'og:image')} AS og_image,
    coalesce({meta('s.html', 'icon')}, {meta('s.html', 'shortcut icon')}) AS favicon,
    {html_to_text('s.html')} AS text,
    lk.internal, lk.external
  FROM {src} s JOIN lk USING ({key})
)"""


def emails(e: str) -> str:
    return clean_distinct(f"regexp_extract_all(coalesce({e}, ''), {lit(re2(K.EMAIL_PATTERN))}, 0)")


def phones(e: str) -> str:
    raw = f"regexp_extract_all(coalesce({e}, ''), {lit(re2(K.PHONE_PATTERN))}, 0)"
    return clean_distinct(f"list_filter({raw}, lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) >= 10)")


def socials(e: str) -> str:
    cond = " OR ".join(f"contains(l, {lit(d)})" for d in K.SOCIAL_DOMAINS)
    return clean_distinct(f"list_filter(coalesce({e}, []), lambda l: {cond})")


def word_count(e: str) -> str:
    return f"coalesce(len(regexp_extract_all({e}, {lit(NWS + '+')}, 0)), 0)"


def audit_cte(src: str, requested: str = "url", h1: str | None = None) -> str:
    """CTE body computing audit columns a_* from a ``sig``-shaped relation."""
    h1e = h1 or f"coalesce(regexp_matches(text, {lit('(?:^|\\n)#' + WS + '+' + NWS)}), false)"
    return f"""
  SELECT *,
    {issues_expr()} AS issues,
    least(100, {points_expr()}) AS opportunity_score
  FROM (
    SELECT *,
      coalesce(starts_with(a_final_url, 'https://'), false) AS https_ok,
      coalesce(length(a_title), 0) AS title_length,
      coalesce(length(a_description), 0) AS description_length,
      {h1e} AS has_h1,
      {word_count('text')} AS words,
      {blank_null('og_title')} IS NOT NULL AS has_og_title,
      {blank_null('og_image')} IS NOT NULL AS has_og_image,
      {blank_null('favicon')} IS NOT NULL AS has_favicon,
      coalesce(status_code <> 0 AND status_code >= 400, false) AS http_error
    FROM (
      SELECT *, coalesce({blank_null('final_url')}, {requested}) AS a_final_url,
        coalesce({blank_null('title')}, {blank_null('og_title')}) AS a_title,
        coalesce({blank_null('description')}, {blank_null('og_description')}) AS a_description
      FROM {src}
    )
  )"""


def _rules():
    P = K.AUDIT_POINTS
    return [
        ("NOT https_ok", lit(K.ISSUE_NOT_HTTPS), P["not_https"]),
        ("a_title IS NULL", lit(K.ISSUE_NO_TITLE), P["no_title"]),
        ("a_title IS NOT NULL AND title_length < 30",
         "'Title too short (' || title_length || ' chars)'", P["title_short"]),
        ("a_title IS NOT NULL AND title_length > 60",
         "'Title too long (' || title_length || ' chars, truncates in search)'", P["title_long"]),
        ("a_description IS NULL", lit(K.ISSUE_NO_DESCRIPTION), P["no_description"]),
        ("a_description IS NOT NULL AND description_length < 70",
         "'Meta description too short (' || description_length || ' chars)'", P["description_short"]),
        ("a_description IS NOT NULL AND description_length > 160",
         "'Meta description too long (' || description_length || ' chars)'", P["description_long"]),
        ("NOT has_h1", lit(K.ISSUE_NO_H1), P["no_h1"]),
        ("NOT (has_og_title AND has_og_image)", lit(K.ISSUE_NO_OG), P["no_og"]),
        ("NOT has_favicon", lit(K.ISSUE_NO_FAVICON), P["no_favicon"]),
        ("words > 0 AND words < 250", "'Thin content (~' || words || ' words on homepage)'", P["thin"]),
        ("http_error", "'Homepage returned HTTP ' || status_code", P["http_error"]),
    ]


def issues_expr() -> str:
    items = ", ".join(f"CASE WHEN {c} THEN {m} END" for c, m, _ in _rules())
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def points_expr() -> str:
    return " + ".join(f"(CASE WHEN {c} THEN {p} ELSE 0 END)" for c, _, p in _rules())


def score_cols(has_seo: str, opp_points: str, n_issues: str, status: str, has_out: str,
               ne: str, np_: str, ns: str, npp: str) -> str:
    """Columns score, reasons (list) from audit/outreach parts."""
    opp = f"CAST(floor(({opp_points} * 120 + 100) / 200) AS INTEGER)"
    reach = (f"least(35, (CASE WHEN {ne} > 0 THEN 18 ELSE 0 END) + (CASE WHEN {np_} > 0 THEN 10 ELSE 0 END)"
             f" + (CASE WHEN {ns} > 0 THEN 4 ELSE 0 END) + (CASE WHEN {npp} > 0 THEN 3 ELSE 0 END))")
    seo_reason = (f"CASE WHEN NOT {has_seo} THEN NULL WHEN {opp} > 0 THEN {n_issues} || ' SEO issue' || "
                  f"(CASE WHEN {n_issues} = 1 THEN '' ELSE 's' END) || ' to pitch (+' || {opp} || ')' "
                  f"ELSE {lit(K.REASON_CLEAN)} END")
    reach_reason = (f"CASE WHEN NOT {has_out} THEN NULL WHEN {reach} > 0 THEN 'reachable: ' || {ne} || ' email / ' || "
                    f"{np_} || ' phone / ' || {ns} || ' social (+' || {reach} || ')' ELSE {lit(K.REASON_NO_CONTACT)} END")
    live = f"({has_seo} AND ({status} IS NULL OR {status} = 0 OR {status} < 400))"
    total = (f"(CASE WHEN {has_seo} AND {opp} > 0 THEN {opp} ELSE 0 END) + (CASE WHEN {has_out} THEN {reach} ELSE 0 END)"
             f" + (CASE WHEN {live} THEN 5 ELSE 0 END)")
    return (f"least(100, {total}) AS score, "
            f"list_filter([{seo_reason}, {reach_reason}], lambda x: x IS NOT NULL) AS reasons")
