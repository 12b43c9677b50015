"""URL and host column expressions (WHATWG-style parsing, the subset pages use).

All functions return native Spark ``Column`` expressions; nothing runs in Python
per row. Supported: absolute http(s) URLs, scheme-relative ``//host``, root
``/path``, ``?query`` and relative paths, dot-segment removal, default-port
removal, host lower-casing, empty path -> ``/``. Documented deviations from a
browser URL parser: non-ASCII path characters are kept as they are (not
percent-encoded) and IDN hosts are lower-cased, not punycoded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# schemes whose authority needs no "//" (the special schemes of the URL standard with a host)
SPECIAL_SCHEMES = ("http", "https", "ftp", "ws", "wss")
# authority may not contain these (WHATWG forbidden host code points, subset)
_BAD_HOST = r"[\x00-\x20#/:<>?@\[\\\]^|%\x7F]"
_ABS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*([^/\\?]*)([^?]*)(\?.*)?\z"
_AUTH = r"^(?:.*@)?([^:]*)(?::(.*))?\z"


def _strip_href(col: Column) -> Column:
    """Leading/trailing C0 controls and spaces removed; tab/CR/LF dropped inside."""
    c = F.regexp_replace(col, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
    return F.regexp_replace(c, r"[\t\n\r]", "")


def _without_fragment(col: Column) -> Column:
    return F.regexp_replace(col, r"(?s)#.*\z", "")


def _encode_path(col: Column) -> Column:
    """Percent-encode the ASCII characters a browser encodes in paths."""
    c = col
    for ch, enc in ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"),
                    ("`", "%60"), ("{", "%7B"), ("}", "%7D")):
        c = F.replace(c, F.lit(ch), F.lit(enc))
    return c


def _encode_query(col: Column) -> Column:
    c = col
    for ch, enc in ((" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("'", "%27")):
        c = F.replace(c, F.lit(ch), F.lit(enc))
    return c


def _remove_dot_segments(path: Column) -> Column:
    segs = F.slice(F.split(path, "/", -1), 2, 1 << 30)

    def step(acc, s):
        return (F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
                .when(s == ".", acc)
                .otherwise(F.concat(acc, F.array(s))))

    def joined(acc):
        trailing = F.when(F.element_at(segs, -1).isin(".", "..") & (F.size(acc) > 0), F.lit("/")).otherwise(F.lit(""))
        return F.concat(F.lit("/"), F.array_join(acc, "/"), trailing)

    out = let(F.aggregate(segs, F.array().cast("array<string>"), step), joined)
    return F.when(path.rlike(r"(^|/)\.\.?(/|\z)"), out).otherwise(path)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and evaluate ``body(value)`` (no re-evaluation per use).

    Higher-order-function bodies get no common-subexpression elimination, so a
    value used several times inside ``transform`` would be recomputed each time."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parse_url_parts(url: Column) -> Column:
    """struct(scheme, host, port, path, query) of an absolute URL, or null."""
    return let(_without_fragment(_strip_href(url)), _parse_clean)


def _parse_clean(u: Column) -> Column:
    cut = F.struct(F.lower(F.regexp_extract(u, _ABS, 1)).alias("scheme"), F.regexp_extract(u, _ABS, 2).alias("auth"))
    return F.when(u.rlike(_ABS), let(cut, lambda c: let(
        F.struct(c["scheme"].alias("scheme"), F.lower(F.regexp_extract(c["auth"], _AUTH, 1)).alias("host"),
                 F.regexp_extract(c["auth"], _AUTH, 2).alias("port")), lambda p: _parse_parts(u, p))))


def _parse_parts(u: Column, parts: Column) -> Column:
    scheme, host, port = parts["scheme"], parts["host"], parts["port"]
    path = F.replace(F.regexp_extract(u, _ABS, 3), F.lit("\\"), F.lit("/"))
    query = F.regexp_extract(u, _ABS, 4)
    # without "//" only the special schemes have a host ("mailto:a@b.com", "acme.com:8080/x" don't)
    has_host = scheme.isin(*SPECIAL_SCHEMES) | u.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://")
    ok = ((scheme != "") & has_host & (host != "") & ~host.rlike(_BAD_HOST)
          & port.rlike(r"^[0-9]*\z") & (F.coalesce(port.try_cast("int"), F.when(port == "", 0).otherwise(65536)) <= 65535))
    return F.when(ok, F.struct(scheme.alias("scheme"), host.alias("host"),
                               port.alias("port"), path.alias("path"), query.alias("query")))


def origin_of(parts: Column) -> Column:
    """``scheme://host[:port]`` of a ``parse_url_parts`` struct (default port dropped)."""
    return F.concat(parts["scheme"], F.lit("://"), parts["host"], _port_suffix(parts["scheme"], parts["port"]))


def _port_suffix(scheme: Column, port: Column) -> Column:
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port.cast("int").cast("string")))


def _serialize(c: Column) -> Column:
    path = c["path"]
    p = let(F.when(path == "", F.lit("/")).otherwise(path), _remove_dot_segments)
    return F.concat(c["scheme"], F.lit("://"), c["host"], _port_suffix(c["scheme"], c["port"]),
                    _encode_path(p), _encode_query(c["query"]))


def normalize_url(url: Column) -> Column:
    """An absolute URL as a browser writes it (host lower-cased, default port and fragment
    gone, empty path ``/``); a URL that can't be parsed stays as it is."""
    parts = parse_url_parts(url)
    return F.coalesce(let(parts, lambda p: F.when(p.isNotNull(), _serialize(p))), url)


def host_of(url: Column) -> Column:
    """Lower-case hostname without a leading ``www.``; null when unparsable (#19)."""
    parts = parse_url_parts(url)
    return F.when(parts.isNotNull(), F.regexp_replace(parts["host"], r"^www\.", ""))


def resolve_url(href: Column, base: Column, base_parsed: bool = False) -> Column:
    """struct(url, host) of ``new URL(href, base)`` if it is http(s), else null.

    ``base_parsed=True`` means ``base`` already is a ``parse_url_parts`` struct
    (parse it once per page, not once per link)."""
    b = base if base_parsed else parse_url_parts(base)
    return let(_strip_href(href), lambda h: _resolve_clean(h, b))


def _resolve_clean(h: Column, b: Column) -> Column:
    # fast path: root-relative links (the common case) are origin + path
    root = h.rlike(r"^/[^/\\]") | (h == "/")
    root_path = let(F.replace(F.regexp_extract(h, r"^([^?]*)", 1), F.lit("\\"), F.lit("/")), _remove_dot_segments)
    fast = F.struct(F.concat(origin_of(b), _encode_path(root_path),
                             _encode_query(F.regexp_extract(h, r"(?s)(\?.*)\z", 1))).alias("url"),
                    b["host"].alias("host"))
    has_scheme = h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    scheme_rel = h.rlike(r"^[/\\]{2}")
    absolute = parse_url_parts(h)
    net = parse_url_parts(F.concat(b["scheme"], F.lit(":"), h))
    # relative to the base: root path, query only, or directory-relative path
    base_dir = F.regexp_extract(b["path"], r"^(.*/)", 1)
    base_dir = F.when(base_dir == "", F.lit("/")).otherwise(base_dir)
    rel_path = (F.when(h.rlike(r"^[/\\]"), F.regexp_extract(h, r"^([^?]*)", 1))
                .when(h.startswith("?"), b["path"])
                .otherwise(F.concat(base_dir, F.regexp_extract(h, r"^([^?]*)", 1))))
    rel_query = F.regexp_extract(h, r"(?s)(\?.*)\z", 1)
    rel_path = F.replace(rel_path, F.lit("\\"), F.lit("/"))
    chosen = (F.when(has_scheme, absolute)
              .when(scheme_rel, net)
              .when(b.isNotNull(), F.struct(b["scheme"].alias("scheme"), b["host"].alias("host"),
                                            b["port"].alias("port"), rel_path.alias("path"),
                                            rel_query.alias("query"))))
    slow = let(chosen, lambda c: F.when(c.isNotNull() & c["scheme"].isin("http", "https"),
                                        F.struct(_serialize(c).alias("url"), c["host"].alias("host"))))
    return F.when(b.isNotNull() & root, fast).otherwise(slow)


def website_of(host: Column) -> Column:
    """``https://{host}`` (#23)."""
    return F.concat(F.lit("https://"), host)


def contact_url(website: Column) -> Column:
    """``new URL('/contact', website)``: origin of the website + ``/contact`` (#23)."""
    r = resolve_url(F.lit("/contact"), website)
    return r["url"]
