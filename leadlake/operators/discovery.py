"""Discovery: search hits -> candidates per channel -> merged, capped candidates (#22, #36-#47).

Plan shape (per spec, all specs in one job):

* hits are joined to the planned queries on the query text; provider fallback is
  a minimum per query and a semi-join, both on the query;
* "first seen per host" is a ``min(struct(ordinals..., payload))`` aggregate, so
  a hot host is pre-aggregated map-side instead of being collected in one task;
* top-k per spec is ``row_number() <= lim`` with the spec's own limit, over rows
  already reduced to one per (spec, host).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlake import constants as K
from leadlake.functions import names as N
from leadlake.functions.urls import host_of, website_of
from leadlake.operators.prune import prune
from leadlake.plans.planning import resolve_queries

CAND_COLS = ["spec_ord", "channel", "channel_ord", "ord", "name", "website", "domain", "description",
             "query", "phone"]


# ------------------------------------------------------------------ hits

def provider_fallback(serp: DataFrame) -> DataFrame:
    """Per query keep only the first provider (by ``provider_ord``) that returned
    anything (#36)."""
    best = serp.groupBy(F.col("query").alias("_q")).agg(F.min("provider_ord").alias("_best"))
    return serp.join(best, (F.col("query") == F.col("_q")) & (F.col("provider_ord") == F.col("_best")), "left_semi")


def top_hits(hits: DataFrame, depth: Column | int) -> DataFrame:
    """First ``depth`` hits per query (#37). Ranks are the 1-based positions the
    reader assigns, so this is a filter, not a window."""
    d = F.lit(depth) if isinstance(depth, int) else depth
    return hits.where(F.col("rank") <= d)


def prepare_hits(serp: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """The hits of the given queries (column ``query``, and ``depth`` for the ranks that
    are wanted; all hits without it) after provider fallback, with ``host`` and ``blocked``.
    The captured hits are pruned to the queries before any URL is parsed: the first provider
    and the depth of each query come from one aggregate over two columns, then one semi-join
    takes the hits themselves. Hits of other queries, or of other providers, are left out in
    the scan (``prune``), so only those that may be wanted are shuffled."""
    if queries is None:
        h = provider_fallback(serp)
    else:
        wanted = queries.groupBy(F.col("query").alias("_wq")).agg(F.max("depth").alias("_wd")).checkpoint()
        asked = prune(serp.select("query", "provider_ord"), ["query"], wanted.select("_wq"))
        best = (asked.join(wanted, F.col("query") == F.col("_wq"))
                .groupBy("_wq").agg(F.min("provider_ord").alias("_best"), F.max("_wd").alias("_wd"))).checkpoint()
        few = prune(serp, ["query", "provider_ord"], best.select("_wq", "_best"))
        h = few.join(best, (F.col("query") == F.col("_wq")) & (F.col("provider_ord") == F.col("_best"))
                      & (F.col("rank") <= F.col("_wd")), "left_semi")
    h = h.drop("provider_ord").withColumn("host", host_of(F.col("url")))
    return h.withColumn("blocked", N.is_blocked(F.col("host")))


def _prepared(serp: DataFrame, queries: DataFrame) -> DataFrame:
    return serp if "blocked" in serp.columns else prepare_hits(serp, queries)


def query_hits(planned: DataFrame, serp: DataFrame, channels: list[str] | None = None) -> DataFrame:
    """Planned queries joined to their (fallback-resolved, depth-limited) hits.
    ``serp`` is raw hits or the output of ``prepare_hits``."""
    p = planned if channels is None else planned.where(F.col("channel").isin(*channels))
    j = p.join(_prepared(serp, p), "query")
    return top_hits(j, F.col("depth"))


# ------------------------------------------------------------------ blocklists / known

def exclude_known(df: DataFrame, known: DataFrame, col: str = "domain") -> DataFrame:
    """Drop rows whose domain is already stored (#22): a left-anti join."""
    k = known.select(F.col("domain").alias("_kd")).distinct()
    return df.join(k, F.col(col) == F.col("_kd"), "left_anti")


def exclude_blocked(df: DataFrame, host_col: str, blocklist: DataFrame, prefixes: bool = True) -> DataFrame:
    """Join form of #20/#21 for large blocklists: every dot-suffix (and, for
    aggregators, dot-prefix) of the host is matched by equi-join against the
    blocklist table ``(domain)``; matching rows are removed with a left-anti join."""
    hosts = df.select(F.col(host_col).alias("_h")).distinct()
    ex = hosts.select("_h", F.explode(_keys_of(F.col("_h"), prefixes)).alias("_k"))
    bad = ex.join(blocklist.select(F.col("domain").alias("_k")).distinct(), "_k").select("_h").distinct()
    return df.join(bad, F.col(host_col) == F.col("_h"), "left_anti")


def _keys_of(host: Column, prefixes: bool) -> Column:
    """Every dot-suffix of ``host`` (itself included) and, optionally, every
    proper dot-prefix."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    keys = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    if prefixes:
        pfx = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                          lambda i: F.array_join(F.slice(parts, 1, i), "."))
        keys = F.concat(keys, F.when(n > 1, pfx).otherwise(F.array().cast("array<string>")))
    return keys


def _first_per(df: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """First row per ``keys`` by ``order`` via ``min(struct(order..., payload...))``."""
    s = F.min(F.struct(*[F.col(c) for c in order + payload])).alias("_m")
    return df.groupBy(*keys).agg(s).select(*keys, *[F.col("_m." + c).alias(c) for c in order + payload])


def _ord(*cols: Column) -> Column:
    names = ["o1", "o2", "o3"]
    vals = list(cols) + [F.lit(0)] * (3 - len(cols))
    return F.struct(*[v.cast("long").alias(n) for v, n in zip(vals, names)])


# ------------------------------------------------------------------ channels

def discover_web(planned: DataFrame, serp: DataFrame, known: DataFrame | None = None, limit: bool = True) -> DataFrame:
    """#38: hit hosts minus blocked/known, first per host by (query, rank), name
    from the title, first ``lim`` per spec; without ``limit`` all of them, for
    ``run_across_specs``, which takes the limit after its own exclusions."""
    h = query_hits(planned, serp, ["web"])
    h = h.where(F.col("host").isNotNull() & ~F.col("blocked"))
    if known is not None:
        h = exclude_known(h, known, "host")
    first = _first_per(h, ["spec_ord", "channel_ord", "host"], ["query_ord", "rank"],
                       ["lim", "title", "description", "query"])
    rn = F.row_number().over(W.partitionBy("spec_ord", "channel_ord").orderBy("query_ord", "rank"))
    top = first.withColumn("_rn", rn).where(F.col("_rn") <= F.col("lim")) if limit else first
    return top.select(
        "spec_ord", F.lit("web").alias("channel"), "channel_ord", _ord(F.col("query_ord"), F.col("rank")).alias("ord"),
        N.pick_name(F.col("title"), F.col("host")).alias("name"), website_of(F.col("host")).alias("website"),
        F.col("host").alias("domain"), "description", "query", F.lit(None).cast("string").alias("phone"))


def resolve_websites(names: DataFrame, serp: DataFrame) -> DataFrame:
    """#39: for each (spec, channel, name) the first hit of the two resolution
    queries whose host is not blocked, not on the channel's own domain, and
    matches the name. ``names`` needs spec_ord, channel, name, location."""
    rq = resolve_queries(names.select("spec_ord", "channel", "name", "location").distinct())
    h = _prepared(serp, rq.select(F.col("rquery").alias("query"), F.col("rdepth").alias("depth")))
    j = rq.join(h, F.col("rquery") == F.col("query")).where(F.col("rank") <= F.col("rdepth"))
    dom = F.coalesce(*[F.when(F.col("channel") == c, F.lit(d)) for c, _, d, *_ in K.CHANNELS if d])
    ok = (F.col("host").isNotNull() & ~F.col("blocked")
          & ~((F.col("host") == dom) | F.col("host").endswith(F.concat(F.lit("."), dom)))
          & N.domain_matches_name(F.col("host"), F.col("name")))
    return _first_per(j.where(F.coalesce(ok, F.lit(False))), ["spec_ord", "channel", "name"],
                      ["rq_ord", "rank"], ["host"]).select("spec_ord", "channel", "name", "host")


def _resolved_candidates(named: DataFrame, serp: DataFrame, limit: bool) -> DataFrame:
    """names (spec_ord, channel, channel_ord, name_ord, name, location, label, lim)
    -> resolved, first name per host, optionally first ``lim`` by name order."""
    named = named.checkpoint()  # names cost much, and are read by each step of the resolution
    res = resolve_websites(named, serp)
    r = named.join(res, ["spec_ord", "channel", "name"])
    first = _first_per(r, ["spec_ord", "channel", "channel_ord", "host"], ["name_ord"], ["name", "label", "lim"])
    if limit:
        rn = F.row_number().over(W.partitionBy("spec_ord", "channel").orderBy("name_ord"))
        first = first.withColumn("_rn", rn).where(F.col("_rn") <= F.col("lim"))
    return first.select(
        "spec_ord", "channel", "channel_ord", F.col("name_ord").alias("ord"), "name",
        website_of(F.col("host")).alias("website"), F.col("host").alias("domain"),
        F.lit(None).cast("string").alias("description"), F.col("label").alias("query"),
        F.lit(None).cast("string").alias("phone"))


def _number_names(df: DataFrame) -> DataFrame:
    """Distinct names per (spec, channel) with the ordinals of their first
    occurrence as ``name_ord`` = struct(k1, k2 * 10^6 + k3, k4) -- a total order,
    so no window numbering all names of a spec is needed."""
    first = _first_per(df, ["spec_ord", "channel", "channel_ord", "name"], ["k1", "k2", "k3", "k4"],
                       ["location", "label", "lim"])
    return first.withColumn("name_ord", _ord(F.col("k1"), F.col("k2") * 1000000 + F.col("k3"), F.col("k4")))


def on_channel_domain(host: Column) -> Column:
    """Whether a hit is on its channel's own domain, sub-domains not counted."""
    dom = F.coalesce(*[F.when(F.col("channel") == c, F.lit(d)) for c, _, d, *_ in K.CHANNELS if d])
    return F.coalesce(host == dom, F.lit(False))


def profile_hit_filter(host: Column, url: Column) -> Column:
    """#26: hits on the channel's own domain whose URL is no list, comparison or hub page."""
    return on_channel_domain(host) & ~url.rlike("(?i)" + K.PROFILE_URL_REJECT)


def discover_profile(planned: DataFrame, serp: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """#40: profile hits on the channel's own domain (no sub-domains, no list/compare
    pages) -> company names from titles (+ g2 snippet names) -> distinct in order ->
    website resolution -> first name per host -> first ``lim``. ``hits``: the prepared
    hits of the planned queries, where the caller has them."""
    chans = [c for c, _, _, kind, *_ in K.CHANNELS if kind == "profile"]
    h = query_hits(planned, serp if hits is None else hits, chans).withColumnRenamed("host", "rhost")
    label = F.coalesce(*[F.when(F.col("channel") == c, F.lit(lb)) for c, lb, *_ in K.CHANNELS])
    h = h.where(on_channel_domain(F.col("rhost")))
    t = (h.where(profile_hit_filter(F.col("rhost"), F.col("url"))).withColumn("name", N.extract_company_name(F.col("title")))
          .where(F.col("name").isNotNull() & (F.lower("name") != F.col("channel")) & (F.lower("name") != F.lower(label)))
          .select("spec_ord", "channel", "channel_ord", "location", "label", "lim", "name",
                  F.lit(0).alias("k1"), F.col("query_ord").alias("k2"), F.col("rank").alias("k3"), F.lit(0).alias("k4")))
    g = (h.where(F.col("channel") == "g2")
          .select("spec_ord", "channel", "channel_ord", "location", "label", "lim", "query_ord", "rank",
                  F.posexplode(N.extract_names_bullets(F.col("description"))).alias("pos", "name"))
          .select("spec_ord", "channel", "channel_ord", "location", "label", "lim", "name",
                  F.lit(1).alias("k1"), F.col("query_ord").alias("k2"), F.col("rank").alias("k3"),
                  F.col("pos").alias("k4")))
    named = _number_names(t.unionByName(g))
    return _resolved_candidates(named, serp, limit=True)


def discover_listing(planned: DataFrame, serp: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """#41: directory snippets -> names (4-60 chars) -> resolution -> first per host."""
    h = query_hits(planned, serp if hits is None else hits, ["yellowpages"])
    n = (h.select("spec_ord", "channel", "channel_ord", "location", "label", "lim", "query_ord", "rank",
                  F.posexplode(N.extract_names_listing(F.col("description"), F.col("niche"))).alias("pos", "name"))
          .where((F.length("name") >= 4) & (F.length("name") <= 60))
          .select("spec_ord", "channel", "channel_ord", "location", "label", "lim", "name",
                  F.col("query_ord").alias("k1"), F.col("rank").alias("k2"), F.col("pos").alias("k3"),
                  F.lit(0).alias("k4")))
    return _resolved_candidates(_number_names(n), serp, limit=False)


def discover_intent(planned: DataFrame, serp: DataFrame) -> DataFrame:
    """#42: first hit per unblocked host over the intent queries; name from the host."""
    h = query_hits(planned, serp, ["quora"])
    h = h.where(F.col("host").isNotNull() & ~F.col("blocked"))
    first = _first_per(h, ["spec_ord", "channel_ord", "host"], ["query_ord", "rank"], ["description", "label"])
    return first.select(
        "spec_ord", F.lit("quora").alias("channel"), "channel_ord", _ord(F.col("query_ord"), F.col("rank")).alias("ord"),
        N.derive_name(F.lit(None).cast("string"), F.col("host")).alias("name"),
        website_of(F.col("host")).alias("website"), F.col("host").alias("domain"), "description",
        F.col("label").alias("query"), F.lit(None).cast("string").alias("phone"))


def discover_places(planned: DataFrame, places: DataFrame, max_pages: int | None = K.PLACES_MAX_PAGES) -> DataFrame:
    """#43: places with a website, first per unblocked host; name from the listing
    or the domain; national phone, else international; address/rating description.
    Only the first ``max_pages`` result pages of a query count (``None``: all).

    ``places``: (query, page_no, pos, p struct) as read by ``read_places``."""
    pq = planned.where(F.col("channel") == "googlemaps").select("spec_ord", "channel_ord", "query", "label")
    pl = places if max_pages is None else places.where(F.col("page_no") < max_pages)
    j = pq.join(pl, "query")
    web = F.col("p.websiteUri")
    j = j.where(F.coalesce(web, F.lit("")) != "").withColumn("host", host_of(web))
    j = j.where(F.col("host").isNotNull() & ~N.is_blocked(F.col("host")))
    nm = F.col("p.displayName.text")
    phone = F.coalesce(F.when(F.col("p.nationalPhoneNumber") != "", F.col("p.nationalPhoneNumber")),
                       F.when(F.col("p.internationalPhoneNumber") != "", F.col("p.internationalPhoneNumber")))
    j = j.select("spec_ord", "channel_ord", "label", "page_no", "pos", "host",
                 F.when(F.coalesce(nm, F.lit("")) != "", nm).alias("pname"), phone.alias("phone"),
                 N.place_description(F.col("p.formattedAddress"), F.col("p.rating"),
                                     F.col("p.userRatingCount")).alias("description"))
    first = _first_per(j, ["spec_ord", "channel_ord", "host"], ["page_no", "pos"],
                       ["pname", "phone", "description", "label"])
    return first.select(
        "spec_ord", F.lit("googlemaps").alias("channel"), "channel_ord",
        _ord(F.col("page_no"), F.col("pos")).alias("ord"),
        F.coalesce(F.col("pname"), N.clean_name_from_domain(F.col("host"))).alias("name"),
        website_of(F.col("host")).alias("website"), F.col("host").alias("domain"), "description",
        F.col("label").alias("query"), "phone")


def discover_channels(planned: DataFrame, serp: DataFrame, places: DataFrame | None,
                      known: DataFrame | None = None, materialize: bool = True,
                      skip_failed: bool = False, limit_web: bool = True) -> DataFrame:
    """#44: union of every channel's candidates. With ``skip_failed`` a channel whose
    plan cannot be built contributes nothing and is logged, as in the application; by
    default the error is raised, so a missing column can't lose a channel unseen.

    The hits of the planned queries feed four channels. With ``materialize`` they are
    pruned and parsed once and checkpointed to the shared folder (a reliable checkpoint
    that also cuts the lineage); the two resolution passes prune the captured hits to
    their own queries."""
    hits = _prepared(serp, planned)
    if materialize:
        hits = hits.checkpoint()
    parts = []
    builders = [
        lambda: discover_web(planned, hits, known, limit_web),
        lambda: discover_listing(planned, serp, hits),
        lambda: discover_intent(planned, hits),
        lambda: discover_profile(planned, serp, hits),
    ]
    if places is not None:
        builders.append(lambda: discover_places(planned, places))
    for b in builders:
        try:
            parts.append(b().select(*CAND_COLS))
        except Exception as e:  # noqa: BLE001 - per-channel isolation, when asked for
            if not skip_failed:
                raise
            import logging
            logging.getLogger("leadlake").warning("channel failed: %s", e)
    if not parts:
        raise ValueError("no channel could be planned")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ------------------------------------------------------------------ merge / counts / cap

def per_channel_counts(cands: DataFrame, planned: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """#46: candidates per (spec, channel) after known-domain exclusion, before the
    cross-channel merge; selected channels without candidates count 0."""
    c = cands if known is None else exclude_known(cands, known)
    counts = c.groupBy("spec_ord", "channel").agg(F.count(F.lit(1)).alias("kept"))
    sel = planned.select("spec_ord", "channel").distinct()
    return sel.join(counts, ["spec_ord", "channel"], "left").select(
        "spec_ord", "channel", F.coalesce(F.col("kept"), F.lit(0)).cast("long").alias("kept"))


def merge_candidates(cands: DataFrame) -> DataFrame:
    """#45: one row per (spec, domain). Encounter order = (channel_ord, ord).
    channels: distinct, in encounter order; name: first of 3+ chars, else the
    first; phone/description: first non-empty; website/query: from the first."""
    o = F.struct(F.col("channel_ord").cast("long").alias("c"), F.col("ord").alias("o"))
    first = F.min(F.struct(o.alias("k"), "name", "website", "query", "channel")).alias("_first")
    good_name = F.min(F.when(F.length("name") >= 3, F.struct(o.alias("k"), F.col("name")))).alias("_gname")
    phone = F.min(F.when(F.coalesce(F.col("phone"), F.lit("")) != "", F.struct(o.alias("k"), F.col("phone")))).alias("_ph")
    desc = F.min(F.when(F.coalesce(F.col("description"), F.lit("")) != "",
                        F.struct(o.alias("k"), F.col("description")))).alias("_de")
    # first encounter of each channel id: at most 8 ids, so 8 conditional minima
    per_ch = [F.min(F.when(F.col("channel") == c, o)).alias("_c_" + c) for c in K.CHANNEL_IDS]
    g = cands.groupBy("spec_ord", "domain").agg(first, good_name, phone, desc, *per_ch)
    seen = F.array(*[F.when(F.col("_c_" + c).isNotNull(), F.struct(F.col("_c_" + c).alias("k"), F.lit(c).alias("ch")))
                     for c in K.CHANNEL_IDS])
    chans = F.transform(F.array_sort(F.array_compact(seen)), lambda x: x["ch"])
    return g.select(
        "spec_ord", "domain",
        F.coalesce(F.col("_gname.name"), F.col("_first.name")).alias("name"),
        F.col("_first.website").alias("website"), F.col("_first.query").alias("query"),
        F.col("_ph.phone").alias("phone"), F.col("_de.description").alias("description"),
        chans.alias("channels"), F.col("_first.k").alias("first_ord"))


def cap_candidates(merged: DataFrame, specs: DataFrame, factor: int | None = K.CANDIDATE_CAP_FACTOR,
                   least: int = K.CANDIDATE_CAP_MIN) -> DataFrame:
    """#47: per spec keep ``max(factor * lim, least)`` candidates, most channels first,
    ties in first-seen order; ``factor=None`` keeps all. Adds ``cand_rank``."""
    lim = specs.select("spec_ord", "lim")
    m = merged.join(lim, "spec_ord")
    rn = F.row_number().over(W.partitionBy("spec_ord").orderBy(F.size("channels").desc(), "first_ord"))
    m = m.withColumn("cand_rank", rn)
    if factor is not None:
        m = m.where(F.col("cand_rank") <= F.greatest(F.col("lim") * factor, F.lit(least)))
    return m.drop("lim")


def cap_across_specs(merged: DataFrame, specs: DataFrame, factor: int | None = K.CANDIDATE_CAP_FACTOR,
                     least: int = K.CANDIDATE_CAP_MIN) -> DataFrame:
    """#76: ``cap_candidates`` for specs that run one after another, where a domain kept by an
    earlier spec is known to the later ones.

    Each round caps every spec on its candidates without the domains that earlier specs kept in
    the round before, until no spec changes. The first spec is right from the start, and a spec is
    right one round after all before it are, so the result is that of the loop over specs, in as
    many rounds as the longest chain of specs that take candidates from one another. A round
    works on narrow rows; only the number of changed rows comes to the driver."""
    kept = cap_candidates(merged, specs, factor, least).select("spec_ord", "domain").checkpoint()
    while True:
        owner = kept.groupBy("domain").agg(F.min("spec_ord").alias("_owner"))
        free = (merged.join(owner, "domain", "left")
                .where(F.col("_owner").isNull() | (F.col("_owner") >= F.col("spec_ord"))).drop("_owner"))
        capped = cap_candidates(free, specs, factor, least)
        now = capped.select("spec_ord", "domain").checkpoint()
        changed = now.exceptAll(kept).unionAll(kept.exceptAll(now)).limit(1).count()
        kept = now
        if not changed:
            return capped


def run_across_specs(cands: DataFrame, specs: DataFrame, factor: int | None = K.CANDIDATE_CAP_FACTOR,
                     least: int = K.CANDIDATE_CAP_MIN) -> DataFrame:
    """#76: merged and capped candidates of specs that run one after another: a domain that an earlier spec kept is
    known to the later ones, before the web channel takes its first ``lim`` hosts and before the cap.

    ``cands``: the candidates of all channels, those of the web channel without limit. As in ``cap_across_specs``
    rounds go on until no spec changes; they work on narrow rows (spec, domain, channel, place), and the
    candidates themselves are merged once, at the end."""
    lim = specs.select(F.col("spec_ord").alias("_spec"), F.col("lim").alias("_lim"))
    place = F.struct(F.col("channel_ord").cast("long").alias("c"), F.col("ord").alias("o"))
    narrow = (cands.join(lim, F.col("spec_ord") == F.col("_spec"))
              .select("spec_ord", "domain", "channel", place.alias("_o"), "_lim").checkpoint())

    def allowed(rows: DataFrame, kept: DataFrame | None) -> DataFrame:
        """Rows that earlier specs leave free; of the web channel the first ``lim`` of those."""
        if kept is not None:
            owner = kept.groupBy(F.col("domain").alias("_d")).agg(F.min("spec_ord").alias("_owner"))
            rows = rows.join(owner, F.col("domain") == F.col("_d"), "left").where(
                F.col("_owner").isNull() | (F.col("_owner") >= F.col("spec_ord"))).drop("_d", "_owner")
        n = F.row_number().over(W.partitionBy("spec_ord", "channel").orderBy("_o"))
        return rows.withColumn("_n", n).where((F.col("channel") != "web") | (F.col("_n") <= F.col("_lim"))).drop("_n")

    kept = None
    while True:
        merged = allowed(narrow, kept).groupBy("spec_ord", "domain").agg(
            F.collect_set("channel").alias("channels"), F.min("_o").alias("first_ord"))
        now = cap_candidates(merged, specs, factor, least).select("spec_ord", "domain").checkpoint()
        same = kept is not None and not now.exceptAll(kept).unionAll(kept.exceptAll(now)).limit(1).count()
        kept = now
        if same:
            break
    rows = cands.join(lim, F.col("spec_ord") == F.col("_spec")).withColumn("_o", place)
    return cap_candidates(merge_candidates(allowed(rows, kept).drop("_spec", "_lim", "_o")), specs, factor, least)
