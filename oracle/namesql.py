"""DuckDB SQL for host predicates and name scalars."""

from __future__ import annotations

import re

from leadlake import constants as K
from oracle.sqlkit import lit, re2, trim_js


def _alt(words):
    return "|".join(re.escape(w) for w in words)


_AGG = _alt(list(dict.fromkeys(K.AGGREGATORS)))
_MIC = _alt(K.MICROSITES)


def is_aggregator(h: str) -> str:
    return (f"(regexp_matches({h}, {lit('(?:^|[.])(?:' + _AGG + r')\z')}) OR "
            f"regexp_matches({h}, {lit('^(?:' + _AGG + r')[.]')}))")


def is_microsite(h: str) -> str:
    return f"regexp_matches({h}, {lit('(?:^|[.])(?:' + _MIC + r')\z')})"


def is_blocked(h: str) -> str:
    return f"coalesce({is_aggregator(h)} OR {is_microsite(h)}, false)"


def label(h: str) -> str:
    return f"split_part({h}, '.', 1)"


def initcap(e: str) -> str:
    """Spark ``initcap``: words split on spaces, first letter upper, rest lower."""
    return (f"array_to_string(list_transform(string_split(lower({e}), ' '), "
            f"lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ')")


def title_case(e: str) -> str:
    return initcap(f"regexp_replace({e}, '[-_]', ' ', 'g')")


def head(e: str) -> str:
    return trim_js(f"regexp_extract({e}, '^([^|\\-–—:·]*)', 1)")


_GEN_T = re2(r"^(" + "|".join(K.GENERIC_TITLE_WORDS) + r")\b", True)
_GEN_P = re2(r"^(" + "|".join(K.GENERIC_PICK_WORDS) + r")\b", True)
_LIST = re2(K.LISTICLE_PATTERN, True)
_CITY = re2(K.CITY_STATE_PATTERN)
_BRAND_JUNK = re2(K.BRAND_JUNK_PATTERN, True)
_GEN_NAME = re2(K.GENERIC_NAME_PATTERN, True)
_SENT = re2(K.SENTENCE_PATTERN)


def derive_name(t: str, h: str) -> str:
    hd = head(t)
    return (f"(CASE WHEN coalesce({t}, '') <> '' AND length({hd}) >= 2 AND NOT regexp_matches({hd}, {lit(_GEN_T)}) "
            f"THEN {hd} ELSE {title_case(label(h))} END)")


def listicle(t: str) -> str:
    return f"(regexp_matches({t}, {lit(_LIST)}) OR regexp_matches({t}, {lit(_CITY)}))"


_SEG = sorted([w for w in K.KNOWN_WORDS if len(w) >= 3], key=len, reverse=True)
_SEG_RE = "^(" + _alt(_SEG) + ")"


def clean_name(h: str) -> str:
    base = f"regexp_replace({label(h)}, '[-_]', ' ', 'g')"
    step = (f"CASE WHEN acc.rest = '' THEN acc "
            f"WHEN regexp_extract(acc.rest, {lit(_SEG_RE)}, 1) <> '' THEN "
            f"{{'rest': substring(acc.rest, length(regexp_extract(acc.rest, {lit(_SEG_RE)}, 1)) + 1), "
            f"'out': acc.out || (CASE WHEN acc.out <> '' THEN ' ' ELSE '' END) || regexp_extract(acc.rest, {lit(_SEG_RE)}, 1)}} "
            f"ELSE {{'rest': substring(acc.rest, 2), 'out': acc.out || substring(acc.rest, 1, 1)}} END")
    seg = f"(list_reduce(range({K.SEGMENT_MAX_STEPS}), lambda acc, i: {step}, {{'rest': lower({base}), 'out': ''}})).out"
    pieces = f"len(list_filter(string_split({seg}, ' '), lambda p: length(p) >= 3))"
    chosen = (f"(CASE WHEN NOT contains({base}, ' ') AND length({base}) > 6 AND {pieces} >= 2 "
              f"THEN {seg} ELSE {base} END)")
    return trim_js(initcap(chosen))


def pick_name(t: str, h: str) -> str:
    hd = head(t)
    return (f"(CASE WHEN coalesce({t}, '') <> '' AND length({hd}) >= 2 AND NOT regexp_matches({hd}, {lit(_GEN_P)}) "
            f"AND NOT {listicle(hd)} THEN {hd} ELSE {clean_name(h)} END)")


def replace_first(e: str, pat: str) -> str:
    flags = ""
    if pat.startswith("(?i)"):
        flags, pat = "(?i)", pat[4:]
    return f"regexp_replace({e}, {lit(flags + '^((?s:.*?))(?:' + pat + ')')}, '\\1')"


def company_name(t: str) -> str:
    e = t
    for p, ci in zip(K.TITLE_JUNK, K.TITLE_JUNK_CASE_INSENSITIVE):
        e = replace_first(e, re2(p, ci))
    e = trim_js(f"regexp_replace({trim_js(e)}, '[.]\\z', '')")
    bad = (f"(regexp_matches(x, {lit(_GEN_NAME)}) OR regexp_matches(x, {lit(_SENT)}) "
           f"OR length(x) < 2 OR length(x) > 70)")
    return f"(SELECT CASE WHEN {t} IS NOT NULL AND NOT {bad} THEN x END FROM (SELECT {e} AS x))"


def domain_matches(h: str, name: str) -> str:
    slug = f"lower({label(f'regexp_replace({h}, {lit(r'^www[.]')}, {lit('')})')})"
    words = f"regexp_split_to_array(lower({name}), {lit(re2(r'[\s&+.,-]+'))})"
    stop = "[" + ", ".join(lit(w) for w in K.STOP_WORDS) + "]"
    longw = f"list_filter({words}, lambda w: length(w) >= 5 AND NOT list_contains({stop}, w))"
    shortw = f"list_filter({words}, lambda w: length(w) >= 3)"
    return (f"(CASE WHEN len({longw}) > 0 THEN "
            f"len(list_filter({longw}, lambda w: contains({slug}, w) OR contains(w, {slug}))) > 0 "
            f"ELSE len(list_filter({shortw}, lambda w: {slug} = w OR starts_with({slug}, w))) > 0 END)")


def brand(og: str, t: str) -> str:
    site = trim_js(f"coalesce({og}, '')")
    hd = head(f"coalesce({t}, '')")
    return (f"(CASE WHEN {site} <> '' AND length({site}) BETWEEN 2 AND 60 THEN {site} "
            f"WHEN length({hd}) BETWEEN 2 AND 60 AND NOT regexp_matches({hd}, {lit(_BRAND_JUNK)}) THEN {hd} END)")


def js_number(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


def place_description(addr: str, rating: str, count: str) -> str:
    a = f"(CASE WHEN coalesce({addr}, '') <> '' THEN {addr} END)"
    c = f"(CASE WHEN coalesce({count}, 0) <> 0 THEN ' (' || {count} || ')' END)"
    star = f"(CASE WHEN {rating} IS NOT NULL THEN '★' || {js_number(rating)} || coalesce({c}, '') END)"
    return f"nullif(concat_ws(' · ', {a}, {star}), '')"


_NICHE_HEAD = re2(r"([A-Za-z][\w\s&'.]{2,50})\s*[-–]\s*")
_NICHE_TAIL = re2(r"[\w\s]*[,.]")
_FROM = re2(r"From Business:\s*([A-Za-z][\w\s&'.]{2,60}?)\s+(?:is |was |has |provides |offers )", True)
_STRIP = [re2(r"\b[A-Z][\w\s]+,\s*[A-Z]{2}\s+\d{5}\b\.?\s*"), re2(r"\b\d{3,5}\s+[A-Z][^.]*\.\s*"),
          re2(r"\b(?:closed now|open now|open \d|temporarily closed)[.,]\s*", True)]


def _name_ok(n: str) -> str:
    return f"(regexp_matches({n}, '^[A-Z]') AND NOT regexp_matches({n}, {lit(_GEN_NAME)}))"


def names_listing(desc: str, niche: str) -> str:
    cleaned = desc
    for p in _STRIP:
        cleaned = f"regexp_replace({cleaned}, {lit(p)}, '', 'g')"
    kw = f"'(?:\\Q' || replace({niche}, '\\E', '\\E\\\\E\\Q') || '\\E|{'|'.join(K.LISTING_TRADE_STEMS)})'"
    pat = f"{lit('(?i)' + _NICHE_HEAD)} || {kw} || {lit(_NICHE_TAIL)}"
    a = f"list_transform(regexp_extract_all({cleaned}, {pat}, 1), lambda x: {trim_js('x')})"
    b = f"list_transform(regexp_extract_all({desc}, {lit(_FROM)}, 1), lambda x: {trim_js('x')})"
    return f"list_filter(list_concat({a}, {b}), lambda n: {_name_ok('n')})"


_G2F = re2(K.G2_FEATURE_PATTERN, True)
_LIKE = re2(r"(?:like|including|such as)\s+([A-Z][\w]+(?:,\s*(?:and\s+)?[A-Z][\w]+)*)")


def names_bullets(desc: str) -> str:
    bullets = (f"list_transform(regexp_split_to_array({desc}, {lit(re2(r'\s*·\s*'))}), "
               f"lambda s: {trim_js(replace_first('s', re2(r'\s*\([\d,]+\).*')))})")
    good_b = (f"list_filter({bullets}, lambda b: length(b) BETWEEN 3 AND 40 AND {_name_ok('b')} "
              f"AND NOT regexp_matches(b, {lit(_G2F)}))")
    parts = (f"list_transform(flatten(list_transform(regexp_extract_all({desc}, {lit(_LIKE)}, 1), "
             f"lambda m: regexp_split_to_array(m, {lit(re2(r',\s*(?:and\s+)?'))}))), lambda x: {trim_js('x')})")
    good_l = f"list_filter({parts}, lambda p: length(p) BETWEEN 3 AND 40 AND {_name_ok('p')})"
    allx = f"list_concat({good_b}, {good_l})"
    return f"list_filter({allx}, lambda x, i: list_position({allx}, x) = i)"
