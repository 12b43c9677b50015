"""Search planning: spec normalisation and query expansion (#8-#18).

Query templates are fixed, short lists, so each spec row expands into its
queries with a generator (``posexplode`` over an array built from the row),
not with a join: no shuffle, and every query carries its ordinals
``(spec_ord, channel_ord, query_ord)`` so first-seen order stays explicit.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from leadlake import constants as K
from leadlake.functions.regex import js_trim


def _fill(template: str, values: dict[str, Column]) -> Column:
    """Template with ``{name}`` placeholders -> concat of literals and columns."""
    parts = []
    for piece in re.split(r"(\{[a-z]+\})", template):
        if not piece:
            continue
        if piece.startswith("{") and piece[1:-1] in values:
            parts.append(values[piece[1:-1]])
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _q(query: Column, depth: int) -> Column:
    return F.struct(query.alias("query"), F.lit(depth).alias("depth"))


def clamp_limit(lim: Column, mode: str) -> Column:
    """Ad hoc: ``min(25, max(1, lim || 10))``; saved: ``lim > 0 ? min(50, lim) : 10``."""
    if mode == "adhoc":
        v = F.when(lim.isNull() | (lim == 0), F.lit(K.DEFAULT_LIMIT)).otherwise(lim)
        return F.least(F.lit(K.ADHOC_LIMIT_MAX), F.greatest(F.lit(1), v)).cast("int")
    return F.when(lim > 0, F.least(F.lit(K.SAVED_LIMIT_MAX), lim)).otherwise(F.lit(K.DEFAULT_LIMIT)).cast("int")


def normalize_specs(specs: DataFrame, mode: str = "adhoc") -> DataFrame:
    """Validated specs (#8): niche trimmed (blank rows dropped), blank location ->
    null, limit defaulted and clamped, only known channels kept (deduplicated; none
    left -> null = all channels)."""
    known = F.array(*[F.lit(c) for c in K.CHANNEL_IDS])
    niche = js_trim(F.col("niche"))
    loc = js_trim(F.col("location"))
    ch = F.array_distinct(F.filter(F.col("channels"), lambda c: F.array_contains(known, c)))
    return (specs.where(niche != "")
                 .select("spec_ord", niche.alias("niche"), F.when(loc != "", loc).alias("location"),
                         clamp_limit(F.col("lim").cast("int"), mode).alias("lim"),
                         F.when(F.size(ch) > 0, ch).alias("channels")))


def spec_channels(specs: DataFrame) -> DataFrame:
    """One row per (spec, selected channel); no selection = all channels in
    dimension order (#9). ``channel_ord`` is the channel's position in the list."""
    all_ch = F.array(*[F.lit(c) for c in K.CHANNEL_IDS])
    chans = F.when(F.size(F.col("channels")) > 0, F.col("channels")).otherwise(all_ch)
    return specs.select("spec_ord", "niche", "location", "lim",
                        F.posexplode(chans).alias("channel_ord", "channel"))


def _vals() -> dict[str, Column]:
    return {"n": F.col("niche"), "loc": F.col("location"), "site": F.lit(K.LINKEDIN_SITE)}


def label_of() -> Column:
    """``{niche} in {location}`` or the niche: the candidates' query label (#15)."""
    return F.when(F.col("location").isNotNull(), _fill("{n} in {loc}", _vals())).otherwise(F.col("niche"))


def web_queries() -> Column:
    v = _vals()
    with_loc = F.array(*[_q(_fill(t, v), K.DEPTH_WEB) for t in K.WEB_TEMPLATES_LOC])
    no_loc = F.array(*[_q(_fill(t, v), K.DEPTH_WEB) for t in K.WEB_TEMPLATES])
    full = F.when(F.col("location").isNotNull(), with_loc).otherwise(no_loc)
    used = F.least(F.size(full), F.greatest(F.lit(5), F.ceil(F.col("lim") / 2).cast("int")))
    return F.slice(full, 1, used)


def listing_queries() -> Column:
    v = _vals()
    q = F.when(F.col("location").isNotNull(), _fill("{n} in {loc} site:yellowpages.com", v)) \
         .otherwise(_fill("{n} site:yellowpages.com", v))
    return F.array(_q(q, K.DEPTH_LISTING))


def intent_queries() -> Column:
    v = dict(_vals())
    v["where"] = F.when(F.col("location").isNotNull(), F.concat(F.lit(" in "), F.col("location"))).otherwise(F.lit(""))
    return F.array(*[_q(_fill(t, v), K.DEPTH_INTENT) for t in K.INTENT_TEMPLATES])


def linkedin_queries() -> Column:
    v = _vals()
    with_loc = F.array(*[_q(_fill(t, v), K.DEPTH_PROFILE) for t in K.LINKEDIN_TEMPLATES_LOC])
    no_loc = F.array(*[_q(_fill(t, v), K.DEPTH_PROFILE) for t in K.LINKEDIN_TEMPLATES])
    return F.when(F.col("location").isNotNull(), with_loc).otherwise(no_loc)


def profile_queries(channel: str) -> Column:
    """Main ``site:`` query, then the channel's extra queries in result order."""
    v = _vals()
    site = dict(K.PROFILE_SITE_PATHS)[channel]
    main = F.when(F.col("location").isNotNull(), F.concat(_fill("{n} {loc} ", v), F.lit(site))) \
            .otherwise(F.concat(_fill("{n} ", v), F.lit(site)))
    items = F.array(_q(main, K.DEPTH_PROFILE))
    if channel == "g2":
        items = F.concat(items, F.array(*[_q(_fill(t, v), K.DEPTH_PROFILE_EXTRA) for t in K.G2_EXTRA_TEMPLATES]))
    if channel == "crunchbase":
        items = F.concat(items, F.array(*[_q(_fill(t, v), K.DEPTH_PROFILE_EXTRA)
                                          for t in K.CRUNCHBASE_EXTRA_TEMPLATES]))
    if channel == "linkedin":
        items = F.concat(items, linkedin_queries())
    return items


def places_queries() -> Column:
    return F.array(_q(label_of(), 20 * K.PLACES_MAX_PAGES))


def _expand(specs: DataFrame, arr: Column, channel: str) -> DataFrame:
    return specs.select("spec_ord", F.lit(channel).alias("channel"),
                        F.posexplode(arr).alias("query_ord", "q"), label_of().alias("label")) \
                .select("spec_ord", "channel", "query_ord", "q.query", "q.depth", "label")


def expand_web_queries(specs: DataFrame) -> DataFrame:
    """#10: first ``min(n, max(5, ceil(lim/2)))`` web templates."""
    return _expand(specs, web_queries(), "web")


def expand_profile_queries(specs: DataFrame, channel: str) -> DataFrame:
    """#11: profile ``site:`` query (+ g2/crunchbase extras)."""
    return _expand(specs, profile_queries(channel), channel)


def expand_linkedin_queries(specs: DataFrame) -> DataFrame:
    """#12: the qualifier fan-out for LinkedIn company pages."""
    return _expand(specs, linkedin_queries(), "linkedin")


def expand_intent_queries(specs: DataFrame) -> DataFrame:
    """#13: recommendation-style queries."""
    return _expand(specs, intent_queries(), "quora")


def expand_listing_queries(specs: DataFrame) -> DataFrame:
    """#14: directory ``site:`` query."""
    return _expand(specs, listing_queries(), "yellowpages")


def expand_places_queries(specs: DataFrame) -> DataFrame:
    """#15: places text query (= the label)."""
    return _expand(specs, places_queries(), "googlemaps")


def channel_queries() -> Column:
    """Array of struct(query, depth) for the row's channel."""
    ch = F.col("channel")
    return (F.when(ch == "web", web_queries())
            .when(ch == "yellowpages", listing_queries())
            .when(ch == "quora", intent_queries())
            .when(ch == "clutch", profile_queries("clutch"))
            .when(ch == "g2", profile_queries("g2"))
            .when(ch == "crunchbase", profile_queries("crunchbase"))
            .when(ch == "linkedin", profile_queries("linkedin"))
            .when(ch == "googlemaps", places_queries()))


def plan_queries(specs: DataFrame) -> DataFrame:
    """All queries of all selected channels (#16):
    ``(spec_ord, channel, channel_ord, query_ord, query, depth, label, niche, location, lim)``."""
    sc = spec_channels(specs)
    return (sc.select("spec_ord", "channel", "channel_ord", "niche", "location", "lim", label_of().alias("label"),
                      F.posexplode(channel_queries()).alias("query_ord", "q"))
              .select("spec_ord", "channel", "channel_ord", "query_ord", "q.query", "q.depth", "label",
                      "niche", "location", "lim"))


def resolve_queries(names: DataFrame) -> DataFrame:
    """The two website-resolution queries per (name, location) (#39)."""
    loc = F.when(F.col("location").isNotNull(), F.concat(F.lit(" "), F.col("location"))).otherwise(F.lit(""))
    v = {"name": F.col("name"), "loc": loc}
    arr = F.array(*[_q(_fill(t, v), K.DEPTH_RESOLVE) for t in K.RESOLVE_TEMPLATES])
    keep = [c for c in names.columns]
    return (names.select(*keep, F.posexplode(arr).alias("rq_ord", "rq"))
                 .select(*keep, "rq_ord", F.col("rq.query").alias("rquery"), F.col("rq.depth").alias("rdepth")))


def compose_location(city: Column, state: Column, country: Column) -> Column:
    """``city, state[, country unless United States]``; the country alone when
    nothing else is chosen (#17)."""
    parts = F.filter(F.array(js_trim(F.coalesce(city, F.lit(""))), F.coalesce(state, F.lit(""))),
                     lambda p: p != "")
    cn = F.coalesce(country, F.lit(""))
    parts = F.when((cn != "") & (cn != "United States"), F.concat(parts, F.array(cn))).otherwise(parts)
    return F.when(F.size(parts) == 0, cn).otherwise(F.array_join(parts, ", "))


def location_cascade(geo: DataFrame, country: str | None = None, state: str | None = None) -> DataFrame:
    """Countries; states of a country; distinct sorted cities of a state (#18)."""
    if country and state:
        return (geo.where((F.col("country_code") == country) & (F.col("state_code") == state))
                   .select(F.col("city").alias("name")).distinct().orderBy("name"))
    if country:
        return (geo.where(F.col("country_code") == country)
                   .select(F.col("state").alias("name"), F.col("state_code").alias("iso_code"))
                   .distinct().orderBy("name"))
    return geo.select(F.col("country").alias("name"), F.col("country_code").alias("iso_code")).distinct().orderBy("name")


def location_levels(geo: DataFrame) -> DataFrame:
    """The whole cascade as one table: rows ``level`` (country, state, city), ``parent`` (codes of the levels
    above, joined by /), ``name``, ``iso_code`` (empty for cities), each once (#18)."""
    countries = location_cascade(geo).select(F.lit("country").alias("level"), F.lit("").alias("parent"), "name", "iso_code")
    states = geo.select(F.lit("state").alias("level"), F.col("country_code").alias("parent"), F.col("state").alias("name"),
                        F.col("state_code").alias("iso_code")).distinct()
    cities = geo.select(F.lit("city").alias("level"), F.concat_ws("/", "country_code", "state_code").alias("parent"),
                        F.col("city").alias("name"), F.lit("").alias("iso_code")).distinct()
    return countries.unionByName(states).unionByName(cities)
