"""Host predicates and business-name scalars as column expressions (#20-#35)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


from leadlake import constants as K
from leadlake.functions.regex import first_segment, js_regex, js_trim


def _alt(words) -> str:
    return "|".join(re.escape(w) for w in words)


def _dedup(seq):
    seen, out = set(), []
    for x in seq:
        if x not in seen:
            seen.add(x)
            out.append(x)
    return out


AGGREGATOR_LIST = _dedup(K.AGGREGATORS)
_AGG_ALT = _alt(AGGREGATOR_LIST)
_MICRO_ALT = _alt(K.MICROSITES)


def is_aggregator(host: Column) -> Column:
    """host = d, ends with ``.d`` or starts with ``d.`` for an aggregator d (#20)."""
    return host.rlike(f"(?:^|\\.)(?:{_AGG_ALT})\\z") | host.rlike(f"^(?:{_AGG_ALT})\\.")


def is_microsite(host: Column) -> Column:
    """host = d or ends with ``.d`` for a booking/microsite host d (#21)."""
    return host.rlike(f"(?:^|\\.)(?:{_MICRO_ALT})\\z")


def is_blocked(host: Column) -> Column:
    return F.coalesce(is_aggregator(host) | is_microsite(host), F.lit(False))


def host_label(host: Column) -> Column:
    """First DNS label of a host."""
    return F.split(host, r"\.", 2)[0]


def title_case(s: Column) -> Column:
    """``s.replace(/[-_]/g, ' ').replace(/\\b\\w/g, upper)`` for host labels."""
    return F.initcap(F.regexp_replace(s, "[-_]", " "))


_GENERIC_TITLE = js_regex(r"^(" + "|".join(K.GENERIC_TITLE_WORDS) + r")\b", ignore_case=True)
_GENERIC_PICK = js_regex(r"^(" + "|".join(K.GENERIC_PICK_WORDS) + r")\b", ignore_case=True)
_LISTICLE = js_regex(K.LISTICLE_PATTERN, ignore_case=True)
_CITY_STATE = js_regex(K.CITY_STATE_PATTERN)
_BRAND_JUNK = js_regex(K.BRAND_JUNK_PATTERN, ignore_case=True)


def title_head(title: Column) -> Column:
    """``title.split(/[|\\-–—:·]/)[0].trim()``."""
    return first_segment(title, K.TITLE_SEPARATORS)


def derive_name(title: Column, host: Column) -> Column:
    """First title segment unless short or generic, else the title-cased host label (#27)."""
    head = title_head(title)
    ok = (F.coalesce(title, F.lit("")) != "") & (F.length(head) >= 2) & ~head.rlike(_GENERIC_TITLE)
    return F.when(ok, head).otherwise(title_case(host_label(host)))


def looks_like_listicle(title: Column) -> Column:
    """Listicle/SEO wording or a ``, XX`` city-state suffix (#28)."""
    return title.rlike(_LISTICLE) | title.rlike(_CITY_STATE)


# Dictionary for the glued-word splitter: entries of 3+ chars, longest first
# (stable for equal lengths), as one ordered alternation.
_SEGMENT_WORDS = sorted([w for w in K.KNOWN_WORDS if len(w) >= 3], key=len, reverse=True)
_SEGMENT_RE = "^(" + _alt(_SEGMENT_WORDS) + ")"


def _segment_step(acc, _i):
    """One step of the greedy glued-word splitter over struct(rest, out)."""
    rest, out = acc["rest"], acc["out"]
    w = F.regexp_extract(rest, _SEGMENT_RE, 1)
    n = F.length(w)
    sep = F.when(out != "", F.lit(" ")).otherwise(F.lit(""))
    by_word = F.struct(rest.substr(n + 1, F.lit(1 << 30)).alias("rest"), F.concat(out, sep, w).alias("out"))
    by_char = F.struct(rest.substr(F.lit(2), F.lit(1 << 30)).alias("rest"),
                       F.concat(out, rest.substr(F.lit(1), F.lit(1))).alias("out"))
    return F.when(rest == "", acc).when(n > 0, by_word).otherwise(by_char)


def clean_name_from_domain(host: Column) -> Column:
    """Readable brand from a domain: first label, ``-``/``_`` -> space; a single
    glued word longer than 6 is split with the dictionary when that yields at
    least two pieces of 3+ characters; then title case (#29)."""
    base = F.regexp_replace(host_label(host), "[-_]", " ")
    seg = F.aggregate(F.sequence(F.lit(1), F.lit(K.SEGMENT_MAX_STEPS)),
                      F.struct(F.lower(base).alias("rest"), F.lit("").alias("out")), _segment_step)["out"]
    pieces = F.size(F.filter(F.split(seg, " "), lambda p: F.length(p) >= 3))
    use_seg = (~base.contains(" ")) & (F.length(base) > 6) & (pieces >= 2)
    chosen = F.when(use_seg, seg).otherwise(base)
    return js_trim(F.initcap(chosen))


def pick_name(title: Column, host: Column) -> Column:
    """Title segment unless generic or listicle, else the cleaned domain (#30)."""
    head = title_head(title)
    ok = ((F.coalesce(title, F.lit("")) != "") & (F.length(head) >= 2)
          & ~head.rlike(_GENERIC_PICK) & ~looks_like_listicle(head))
    return F.when(ok, head).otherwise(clean_name_from_domain(host))


def replace_first(col: Column, java_pattern: str) -> Column:
    """JavaScript ``str.replace(re, '')`` without ``g``: remove the leftmost match only."""
    flags = ""
    pat = java_pattern
    if pat.startswith("(?i)"):
        flags, pat = "(?i)", pat[4:]
    return F.regexp_replace(col, f"{flags}^((?s:.*?))(?:{pat})", "$1")


_JUNK = [js_regex(p, ci) for p, ci in zip(K.TITLE_JUNK, K.TITLE_JUNK_CASE_INSENSITIVE)]
_GENERIC_NAME = js_regex(K.GENERIC_NAME_PATTERN, ignore_case=True)
_SENTENCE = js_regex(K.SENTENCE_PATTERN)


def extract_company_name(title: Column) -> Column:
    """Company name from a profile-page title (#31): strip the junk suffixes in
    order, trim, drop a final ``.``; null if generic, sentence-like or not 2-70 long."""
    t = title
    for p in _JUNK:
        t = replace_first(t, p)
    t = js_trim(F.regexp_replace(js_trim(t), r"\.\z", ""))
    bad = t.rlike(_GENERIC_NAME) | t.rlike(_SENTENCE) | (F.length(t) < 2) | (F.length(t) > 70)
    return F.when(title.isNotNull() & ~bad, t)


_STOP = K.STOP_WORDS
_NAME_SPLIT = js_regex(r"[\s&+.,-]+")


def domain_matches_name(host: Column, name: Column) -> Column:
    """The resolved domain plausibly belongs to the company name (#25)."""
    slug = F.lower(host_label(F.regexp_replace(host, r"^www\.", "")))
    words = F.split(F.lower(name), _NAME_SPLIT)
    stop = F.array(*[F.lit(w) for w in _STOP])
    long_words = F.filter(words, lambda w: (F.length(w) >= 5) & ~F.array_contains(stop, w))
    short_words = F.filter(words, lambda w: F.length(w) >= 3)
    long_hit = F.exists(long_words, lambda w: slug.contains(w) | w.contains(slug))
    short_hit = F.exists(short_words, lambda w: (slug == w) | slug.startswith(w))
    return F.when(F.size(long_words) > 0, long_hit).otherwise(short_hit)


def _quote(niche: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(niche, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


_UPPER_START = "^[A-Z]"
_LISTING_STRIP = [js_regex(K.LISTING_ADDRESS_PATTERN), js_regex(K.LISTING_STREET_PATTERN), js_regex(K.LISTING_HOURS_PATTERN, ignore_case=True)]
_FROM_RE = js_regex(K.FROM_BUSINESS_PATTERN, ignore_case=True)


def _name_ok(n: Column) -> Column:
    return n.rlike(_UPPER_START) & ~n.rlike(_GENERIC_NAME)


def extract_names_listing(description: Column, niche: Column) -> Column:
    """Business names in a directory snippet (#32): after stripping address and
    open/closed text, ``Name - {niche or trade}...[,.]``; plus ``From Business:
    Name is ...`` on the raw text. Upper-case start, not generic; in order."""
    cleaned = description
    for p in _LISTING_STRIP:
        cleaned = F.regexp_replace(cleaned, p, "")
    kw = F.concat(F.lit("(?:(?u:"), _quote(niche), F.lit(")|" + "|".join(K.LISTING_TRADE_STEMS) + ")"))
    niche_re = F.concat(F.lit("(?i)" + js_regex(r"([A-Za-z][\w\s&'.]{2,50})\s*[-–]\s*")), kw,
                        F.lit(js_regex(r"[\w\s]*[,.]")))
    a = F.transform(F.regexp_extract_all(cleaned, niche_re, 1), js_trim)
    b = F.transform(F.regexp_extract_all(description, F.lit(_FROM_RE), 1), js_trim)
    return F.filter(F.concat(a, b), lambda n: _name_ok(n))


_BULLET_SPLIT = js_regex(K.BULLET_SPLIT_PATTERN)
_BULLET_COUNT = js_regex(K.BULLET_COUNT_PATTERN)
_G2_FEATURE = js_regex(K.G2_FEATURE_PATTERN, ignore_case=True)
_LIKE_RE = js_regex(K.LIKE_PATTERN)
_LIKE_SPLIT = js_regex(K.LIKE_SPLIT_PATTERN)


def extract_names_bullets(description: Column) -> Column:
    """Product names from category snippets (#33): ``A · B · C`` bullets (count
    suffix removed, 3-40 chars, upper start, not generic, not a feature word) and
    ``like/including/such as A, B, and C`` lists; distinct, in order."""
    bullets = F.transform(F.split(description, _BULLET_SPLIT), lambda s: js_trim(replace_first(s, _BULLET_COUNT)))
    good_b = F.filter(bullets, lambda b: (F.length(b) >= 3) & (F.length(b) <= 40) & _name_ok(b)
                      & ~b.rlike(_G2_FEATURE))
    lists = F.regexp_extract_all(description, F.lit(_LIKE_RE), 1)
    parts = F.transform(F.flatten(F.transform(lists, lambda m: F.split(m, _LIKE_SPLIT))), js_trim)
    good_l = F.filter(parts, lambda p: (F.length(p) >= 3) & (F.length(p) <= 40) & _name_ok(p))
    return F.array_distinct(F.concat(good_b, good_l))


def brand_name(og_title: Column, title: Column) -> Column:
    """og:title if 2-60 long, else the first title segment if 2-60 long and not
    ranking wording, else null (#34)."""
    site = js_trim(F.coalesce(og_title, F.lit("")))
    head = title_head(F.coalesce(title, F.lit("")))
    site_ok = (site != "") & (F.length(site) >= 2) & (F.length(site) <= 60)
    head_ok = (F.length(head) >= 2) & (F.length(head) <= 60) & ~head.rlike(_BRAND_JUNK)
    return F.when(site_ok, site).when(head_ok, head)


def js_number(x: Column) -> Column:
    """Number -> string as JavaScript prints it (no ``.0`` on integral values)."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def place_description(address: Column, rating: Column, count: Column) -> Column:
    """``address · ★rating (count)``; count only when non-zero; null if empty (#35)."""
    addr = F.when(F.coalesce(address, F.lit("")) != "", address)
    cnt = F.when(F.coalesce(count, F.lit(0)) != 0, F.concat(F.lit(" ("), count.cast("string"), F.lit(")")))
    star = F.when(rating.isNotNull(), F.concat(F.lit("★"), js_number(rating), F.coalesce(cnt, F.lit(""))))
    bits = F.concat_ws(" · ", addr, star)
    return F.when(bits != "", bits)
