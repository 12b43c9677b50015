"""HTML signal extraction as column expressions (#24, #48-#51, #55)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


from leadlake import constants as K
from leadlake.functions.regex import WS, WS_CHARS, NWS, blank_to_null, js_trim
from leadlake.functions.urls import let, resolve_url

_SCRIPT = "(?is)" + K.SCRIPT_PATTERN
_STYLE = "(?is)" + K.STYLE_PATTERN
# runs of whitespace that aren't one U+0020 already
_RUNS = f"(?: {WS}|[{WS_CHARS.replace(' ', '')}]){WS}*"
_TITLE = "(?i)" + K.TITLE_PATTERN
_ANCHOR = "(?i)" + K.ANCHOR_PATTERN


def html_to_text(html: Column) -> Column:
    """Scripts and styles dropped, tags -> space, whitespace collapsed, trimmed (#48)."""
    t = F.regexp_replace(html, _SCRIPT, " ")
    t = F.regexp_replace(t, _STYLE, " ")
    t = F.regexp_replace(t, K.TAG_PATTERN, " ")
    t = F.regexp_replace(t, _RUNS, " ")
    # every whitespace run is now one U+0020, so trimming spaces is the full trim
    return F.btrim(t, F.lit(" "))


def extract_title(html: Column) -> Column:
    """``<title>`` text trimmed; empty or absent -> null (#49)."""
    return blank_to_null(F.regexp_extract(html, _TITLE, 1))


def _meta_pattern(key: str) -> str:
    return (r"""(?i)<meta[^>]+(?:name|property)=["']""" + key
            + r"""["'][^>]+content=["']([^"']+)["']|<meta[^>]+content=["']([^"']+)["'][^>]+(?:name|property)=["']"""
            + key + r"""["']""")


#: the keys that page signals are read from
META_KEYS = ("description", "og:title", "og:description", "og:image", "icon", "shortcut icon")


def meta_tags(html: Column, keys: tuple[str, ...] = META_KEYS) -> Column:
    """The meta tags with one of the keys, to their ends, as a short text in which ``meta_content`` finds what it
    finds in the page: one pass over the page instead of two for every key. The tags are captured in a
    look-ahead, so that a tag inside a malformed one is found too. Only a tag that is never closed, before
    one with ``>`` in a value, may have that value cut there."""
    pattern = _meta_pattern("(?:" + "|".join(keys) + ")").removeprefix("(?i)").replace("([^", "(?:[^")
    return F.array_join(F.regexp_extract_all(html, F.lit(f"(?i)(?=((?:{pattern})[^>]*))<meta"), F.lit(1)), ">")


def meta_content(html: Column, key: str) -> Column:
    """Content of ``<meta name|property=key content=...>``, either attribute order,
    leftmost tag wins; trimmed, blank -> null (#50)."""
    pat = _meta_pattern(key)
    g1 = F.regexp_extract(html, pat, 1)
    g2 = F.regexp_extract(html, pat, 2)
    return blank_to_null(F.coalesce(F.nullif(g1, F.lit("")), g2))


def favicon(html: Column, source: str = "meta") -> Column:
    """Favicon signal. ``meta`` (default) reads ``<meta name=icon>`` like the
    application does; ``link`` reads ``<link rel=icon href=...>``."""
    if source == "link":
        pat = r"""(?i)<link[^>]+rel=["'](?:shortcut )?icon["'][^>]+href=["']([^"']+)["']"""
        return blank_to_null(F.regexp_extract(html, pat, 1))
    return F.coalesce(meta_content(html, "icon"), meta_content(html, "shortcut icon"))


def extract_links(html: Column, base_parts: Column) -> Column:
    """struct(internal, external): resolved http(s) anchors without ``#``, split by
    hostname equality with the base, each deduplicated in order (#24).

    ``base_parts`` is the page URL parsed by ``parse_url_parts`` (a column)."""
    base_host = base_parts["host"]
    hrefs = F.regexp_extract_all(html, F.lit(_ANCHOR), 1)
    resolved = F.filter(F.transform(hrefs, lambda h: resolve_url(h, base_parts, base_parsed=True)),
                        lambda r: r.isNotNull())

    def by_host(links: Column) -> Column:
        internal = F.transform(F.filter(links, lambda r: r["host"] == base_host), lambda r: r["url"])
        external = F.transform(F.filter(links, lambda r: ~r["host"].eqNullSafe(base_host)), lambda r: r["url"])
        return F.struct(F.array_distinct(internal).alias("internal"),
                        F.array_distinct(external).alias("external"))

    return let(resolved, by_host)


def word_count(text: Column, normalized: bool = False) -> Column:
    """Number of whitespace-separated tokens; 0 for empty/null text (#55).

    ``normalized=True`` is for text from ``html_to_text`` (single spaces, no
    leading/trailing space): one literal split, no regex."""
    if normalized:
        return F.when(F.coalesce(text, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(text, " "))).cast("int")
    parts = F.split(F.coalesce(text, F.lit("")), f"{WS}+")
    n = F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) \
        - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return F.greatest(n, F.lit(0)).cast("int")


def has_markdown_h1(text: Column) -> Column:
    """``/(^|\\n)#\\s+\\S/`` on the page text."""
    return F.coalesce(text.rlike(f"(?:^|\\n)#{WS}+{NWS}"), F.lit(False))


def has_html_h1(html: Column) -> Column:
    return F.coalesce(html.rlike(r"(?i)<h1[\s>]"), F.lit(False))
