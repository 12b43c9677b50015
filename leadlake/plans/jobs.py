"""

Every job takes ``(spark, sf_dir)`` and returns a DataFrame whose columns match
the DuckDB oracle's (arrays are emitted joined with ``"; "``; counts as
BIGINT). The jobs only compose library operators; no logic lives here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake import fixtures as FX
from leadlake.functions import contacts as C
from leadlake.functions import html as H
from leadlake.operators import pages as P
from leadlake.sources.readers import read_pages

JOBS: dict = {}


def job(name: str):
    """Register a job; it applies the library's runtime settings to the session it is given."""
    def deco(fn):
        import functools

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from leadlake.session import configure, ensure_checkpoint_dir
            configure(spark)
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)
        JOBS[name] = run
        return fn
    return deco


def joined(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(c, "; ")


def big(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("long")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    FX.pages(spark, sf_dir)
    return read_pages(spark, FX.fixture_path(spark, sf_dir, "pages"))


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.materialized(spark, sf_dir, "rich_pages", FX.rich_pages)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FX.materialized(spark, sf_dir, "documents", lambda s, d: FX.table(s, d, "documents").select("doc_id", "text"))


# ---------------------------------------------------------------- pages / flagship

@job("score_pages")
def score_pages(spark, sf_dir):
    """Flagship: pages -> text/metadata/links -> contacts -> audit -> score, best first.

    The narrow scored rows are checkpointed before the global sort, so the range
    partitioner samples them instead of re-running the regex work."""
    s = P.score_pages(_pages(spark, sf_dir)).checkpoint()
    return s.select(
        "page_id", "url", big("score").alias("score"),
        big("seo.opportunity_score").alias("opportunity_score"),
        big(F.size("seo.issues")).alias("issues_count"),
        joined("seo.issues").alias("issues"), joined("score_reasons").alias("reasons"),
        joined("outreach.emails").alias("emails"), joined("outreach.phones").alias("phones"),
        joined("outreach.socials").alias("socials"),
    ).orderBy(F.col("score").desc(), "page_id")


@job("html_to_text")
def html_to_text(spark, sf_dir):
    p = _pages(spark, sf_dir)
    t = H.html_to_text(F.col("html"))
    return p.select("page_id", F.md5(t).alias("text_md5"), big(F.length(t)).alias("text_chars"))


@job("extract_title")
def extract_title(spark, sf_dir):
    p = _pages(spark, sf_dir).unionByName(_rich(spark, sf_dir).select("page_id", "url", "html")
                                          .withColumn("page_id", F.col("page_id") + 1_000_000))
    return p.select("page_id", H.extract_title(F.col("html")).alias("title"))


@job("page_metadata")
def page_metadata(spark, sf_dir):
    s = P.page_signals(_rich(spark, sf_dir))
    return s.select("page_id", "final_url", big("status_code").alias("status_code"), "title", "description",
                    "og_title", "og_description", "og_image", "favicon")


@job("extract_links")
def extract_links(spark, sf_dir):
    rich = _rich(spark, sf_dir).select("page_id", "url", "html")
    raw = _pages(spark, sf_dir).withColumn("page_id", F.col("page_id") + 1_000_000)
    s = P.page_signals(rich.unionByName(raw), keep=["page_id"])
    return s.select("page_id", joined("links.internal").alias("internal"),
                    joined("links.external").alias("external"),
                    big(F.size("links.internal")).alias("n_internal"),
                    big(F.size("links.external")).alias("n_external"))


@job("extract_emails")
def extract_emails(spark, sf_dir):
    e = C.extract_emails(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", joined(e).alias("emails"), big(F.size(e)).alias("n_emails"))


@job("extract_phones")
def extract_phones(spark, sf_dir):
    e = C.extract_phones(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", joined(e).alias("phones"), big(F.size(e)).alias("n_phones"))


@job("extract_socials")
def extract_socials(spark, sf_dir):
    s = P.page_signals(_rich(spark, sf_dir))
    return s.select("page_id", joined(C.extract_socials(F.col("links.external"))).alias("socials"),
                    joined(C.extract_socials(F.col("links.external"), "host")).alias("socials_host"))


@job("word_count")
def word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", big(H.word_count(F.col("text"))).alias("words"))


def _audit_out(df: DataFrame) -> DataFrame:
    return df.select(
        "page_id", "seo.final_url", "seo.https_ok", big("seo.status_code").alias("status_code"),
        "seo.title", big("seo.title_length").alias("title_length"), "seo.description",
        big("seo.description_length").alias("description_length"), "seo.has_h1", "seo.has_og_title",
        "seo.has_og_image", "seo.has_favicon", big("seo.word_count").alias("word_count"),
        joined("seo.issues").alias("issues"), big("seo.opportunity_score").alias("opportunity_score"))


@job("audit_seo")
def audit_seo(spark, sf_dir):
    return _audit_out(P.audit_pages(_rich(spark, sf_dir)))


@job("score_lead")
def score_lead(spark, sf_dir):
    s = P.score_pages(_rich(spark, sf_dir))
    return s.select("page_id", big("score").alias("score"), joined("score_reasons").alias("reasons"))


@job("scrape_report")
def scrape_report(spark, sf_dir):
    r = P.scrape_report(_rich(spark, sf_dir))
    return r.select("page_id", "url", big("status_code").alias("status_code"),
                    big("internal_links").alias("internal_links"), big("external_links").alias("external_links"),
                    joined("emails").alias("emails"), joined("phones").alias("phones"),
                    joined("socials").alias("socials"), "title", "description", "og_title",
                    "has_og_image", "has_favicon", "has_h1", big("text_length").alias("text_length"))


@job("successful_pages")
def successful_pages(spark, sf_dir):
    return P.successful_pages(_rich(spark, sf_dir)).select("page_id", "success", "error")


# ---------------------------------------------------------------- discovery inputs

from leadlake.functions import names as N  # noqa: E402
from leadlake.functions import urls as U  # noqa: E402
from leadlake.operators import discovery as D  # noqa: E402
from leadlake.operators import enrich as EN  # noqa: E402
from leadlake.plans import planning as PL  # noqa: E402


def _fx(spark, sf_dir, name):
    builders = {"specs": FX.specs, "serp": FX.all_serp, "places": FX.places, "home_pages": FX.home_pages,
                "known": FX.known, "profile_hits": FX.profile_hits, "resolve_hits": FX.resolve_hits,
                "rich_pages": FX.rich_pages}
    return FX.materialized(spark, sf_dir, name, builders[name])


def _specs(spark, sf_dir):
    return PL.normalize_specs(_fx(spark, sf_dir, "specs"))


def _planned(spark, sf_dir):
    return PL.plan_queries(_specs(spark, sf_dir))


def _serp(spark, sf_dir):
    return _fx(spark, sf_dir, "serp")


# ---------------------------------------------------------------- planning

@job("normalize_specs")
def normalize_specs(spark, sf_dir):
    s = _specs(spark, sf_dir)
    return s.select(big("spec_ord").alias("spec_ord"), "niche", "location", big("lim").alias("lim"),
                    F.coalesce(joined("channels"), F.lit("<all>")).alias("channels"))


@job("normalize_specs_saved")
def normalize_specs_saved(spark, sf_dir):
    s = PL.normalize_specs(_fx(spark, sf_dir, "specs"), mode="saved")
    return s.select(big("spec_ord").alias("spec_ord"), big("lim").alias("lim"))


@job("spec_channels")
def spec_channels(spark, sf_dir):
    s = PL.spec_channels(_specs(spark, sf_dir))
    return s.select(big("spec_ord").alias("spec_ord"), "channel", big("channel_ord").alias("channel_ord"))


def _expansion(df):
    return df.select(big("spec_ord").alias("spec_ord"), "channel", big("query_ord").alias("query_ord"), "query",
                     big("depth").alias("depth"), "label")


@job("expand_web_queries")
def expand_web_queries(spark, sf_dir):
    return _expansion(PL.expand_web_queries(_specs(spark, sf_dir)))


@job("expand_profile_queries")
def expand_profile_queries(spark, sf_dir):
    s = _specs(spark, sf_dir)
    out = None
    for ch in ("clutch", "g2", "crunchbase"):
        e = PL.expand_profile_queries(s, ch)
        out = e if out is None else out.unionByName(e)
    return _expansion(out)


@job("expand_linkedin_queries")
def expand_linkedin_queries(spark, sf_dir):
    return _expansion(PL.expand_linkedin_queries(_specs(spark, sf_dir)))


@job("expand_intent_queries")
def expand_intent_queries(spark, sf_dir):
    return _expansion(PL.expand_intent_queries(_specs(spark, sf_dir)))


@job("expand_listing_queries")
def expand_listing_queries(spark, sf_dir):
    return _expansion(PL.expand_listing_queries(_specs(spark, sf_dir)))


@job("expand_places_queries")
def expand_places_queries(spark, sf_dir):
    return _expansion(PL.expand_places_queries(_specs(spark, sf_dir)))


@job("plan_queries")
def plan_queries(spark, sf_dir):
    p = _planned(spark, sf_dir)
    return p.select(big("spec_ord").alias("spec_ord"), "channel", big("channel_ord").alias("channel_ord"),
                    big("query_ord").alias("query_ord"), "query", big("depth").alias("depth"), "label")


def _geo(spark, sf_dir):
    c = FX.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = FX.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = FX.table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    g = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    country = F.when(F.col("r_regionkey") == 1, F.lit("United States")).otherwise(F.col("r_name"))
    return g.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("country_code"),
                    country.alias("country"),
                    F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("state_code"),
                    F.col("n_name").alias("state"),
                    F.when(F.col("c_custkey") % 11 == 0, F.lit(" "))
                     .otherwise(F.concat(F.lit("City "), (F.col("c_custkey") % 37).cast("string"))).alias("city"))


@job("compose_location")
def compose_location(spark, sf_dir):
    g = _geo(spark, sf_dir).distinct()
    return g.select("country_code", "state_code", "city",
                    PL.compose_location(F.col("city"), F.col("state"), F.col("country")).alias("location"),
                    PL.compose_location(F.lit(None), F.lit(None), F.col("country")).alias("country_only"),
                    PL.compose_location(F.lit(None), F.col("state"), F.col("country")).alias("state_only"))


@job("location_cascade")
def location_cascade(spark, sf_dir):
    return PL.location_levels(_geo(spark, sf_dir))


# ---------------------------------------------------------------- hosts and names

def _hit_hosts(spark, sf_dir):
    s = _serp(spark, sf_dir).select("url").distinct()
    return s.select("url", U.host_of(F.col("url")).alias("host"))


@job("host_of")
def host_of(spark, sf_dir):
    return _hit_hosts(spark, sf_dir)


@job("is_aggregator")
def is_aggregator(spark, sf_dir):
    h = _hit_hosts(spark, sf_dir).where(F.col("host").isNotNull()).select("host").distinct()
    return h.select("host", N.is_aggregator(F.col("host")).alias("aggregator"),
                    N.is_microsite(F.col("host")).alias("microsite"))


@job("is_microsite")
def is_microsite(spark, sf_dir):
    h = _hit_hosts(spark, sf_dir).where(F.col("host").isNotNull()).select("host").distinct()
    return h.where(N.is_microsite(F.col("host"))).select("host")


@job("exclude_known")
def exclude_known(spark, sf_dir):
    h = _hit_hosts(spark, sf_dir).where(F.col("host").isNotNull()).select(F.col("host").alias("domain")).distinct()
    return D.exclude_known(h, _fx(spark, sf_dir, "known"))


@job("website_contact_url")
def website_contact_url(spark, sf_dir):
    h = _hit_hosts(spark, sf_dir).where(F.col("host").isNotNull()).select("host").distinct()
    w = U.website_of(F.col("host"))
    return h.select("host", w.alias("website"), U.contact_url(w).alias("contact_url"))


@job("domain_matches_name")
def domain_matches_name(spark, sf_dir):
    r = _fx(spark, sf_dir, "resolve_hits")
    x = r.select(F.regexp_extract("query", r'^"([^"]+)"', 1).alias("name"), "url").where(F.col("name") != "")
    x = x.select("name", U.host_of(F.col("url")).alias("host")).where(F.col("host").isNotNull()).distinct()
    return x.select("name", "host", N.domain_matches_name(F.col("host"), F.col("name")).alias("matches"))


@job("profile_hit_filter")
def profile_hit_filter(spark, sf_dir):
    h = _fx(spark, sf_dir, "profile_hits")
    p = _planned(spark, sf_dir).select("query", "channel").distinct()
    j = h.join(p, "query")
    keep = D.profile_hit_filter(U.host_of(F.col("url")), F.col("url"))
    return j.select("channel", "url", keep.alias("kept")).distinct()


def _titles(spark, sf_dir):
    s = _serp(spark, sf_dir).select("url", "title").distinct()
    return s.select("title", U.host_of(F.col("url")).alias("host")).where(F.col("host").isNotNull()).distinct()


@job("derive_name")
def derive_name(spark, sf_dir):
    t = _titles(spark, sf_dir)
    return t.select("title", "host", N.derive_name(F.col("title"), F.col("host")).alias("name"),
                    N.derive_name(F.lit(None).cast("string"), F.col("host")).alias("host_name"))


@job("looks_like_listicle")
def looks_like_listicle(spark, sf_dir):
    t = _serp(spark, sf_dir).select("title").distinct()
    return t.select("title", N.looks_like_listicle(F.col("title")).alias("listicle"))


def _all_hosts(spark, sf_dir):
    a = _hit_hosts(spark, sf_dir).where(F.col("host").isNotNull()).select("host")
    b = _fx(spark, sf_dir, "places").select(U.host_of(F.col("p.websiteUri")).alias("host")).where(F.col("host").isNotNull())
    return a.unionByName(b).distinct()


@job("clean_name_from_domain")
def clean_name_from_domain(spark, sf_dir):
    h = _all_hosts(spark, sf_dir)
    return h.select("host", N.clean_name_from_domain(F.col("host")).alias("name"))


@job("pick_name")
def pick_name(spark, sf_dir):
    t = _titles(spark, sf_dir)
    return t.select("title", "host", N.pick_name(F.col("title"), F.col("host")).alias("name"))


@job("extract_company_name")
def extract_company_name(spark, sf_dir):
    t = _fx(spark, sf_dir, "profile_hits").select("title").distinct()
    return t.select("title", N.extract_company_name(F.col("title")).alias("name"))


@job("extract_names_listing")
def extract_names_listing(spark, sf_dir):
    h = D.query_hits(_planned(spark, sf_dir), _serp(spark, sf_dir), ["yellowpages"])
    d = h.select("description", "niche").distinct()
    return d.select("description", "niche", joined(N.extract_names_listing(F.col("description"), F.col("niche")))
                    .alias("names"))


@job("extract_names_bullets")
def extract_names_bullets(spark, sf_dir):
    d = _fx(spark, sf_dir, "profile_hits").select("description").distinct()
    return d.select("description", joined(N.extract_names_bullets(F.col("description"))).alias("names"))


@job("brand_name")
def brand_name(spark, sf_dir):
    s = P.page_signals(_rich(spark, sf_dir))
    return s.select("page_id", N.brand_name(F.col("og_title"), F.col("title")).alias("brand"))


@job("place_description")
def place_description(spark, sf_dir):
    p = _fx(spark, sf_dir, "places")
    return p.select("query", big("page_no").alias("page_no"), big("pos").alias("pos"),
                    N.place_description(F.col("p.formattedAddress"), F.col("p.rating"),
                                        F.col("p.userRatingCount")).alias("description"))


# ---------------------------------------------------------------- discovery

def _cands_out(df: DataFrame) -> DataFrame:
    return df.select(big("spec_ord").alias("spec_ord"), "channel", big("channel_ord").alias("channel_ord"),
                     big("ord.o1").alias("o1"), big("ord.o2").alias("o2"), big("ord.o3").alias("o3"),
                     "name", "website", "domain", "description", "query", "phone")


@job("provider_fallback")
def provider_fallback(spark, sf_dir):
    s = D.provider_fallback(_serp(spark, sf_dir))
    return s.select("query", big("provider_ord").alias("provider_ord"), big("rank").alias("rank"), "url")


@job("top_hits")
def top_hits(spark, sf_dir):
    h = D.query_hits(_planned(spark, sf_dir), _serp(spark, sf_dir))
    return h.select(big("spec_ord").alias("spec_ord"), "channel", big("query_ord").alias("query_ord"),
                    big("rank").alias("rank"), "url")


@job("discover_web")
def discover_web(spark, sf_dir):
    return _cands_out(D.discover_web(_planned(spark, sf_dir), _serp(spark, sf_dir), _fx(spark, sf_dir, "known")))


@job("resolve_websites")
def resolve_websites(spark, sf_dir):
    pl = _planned(spark, sf_dir).select("spec_ord", "channel", "location").distinct()
    names = _fx(spark, sf_dir, "profile_hits").select("query", N.extract_company_name(F.col("title")).alias("name"))
    qs = _planned(spark, sf_dir).select("query", "spec_ord", "channel", "location")
    n = names.join(qs, "query").where(F.col("name").isNotNull()).select("spec_ord", "channel", "name", "location")
    r = D.resolve_websites(n, _serp(spark, sf_dir))
    return r.select(big("spec_ord").alias("spec_ord"), "channel", "name", "host")


@job("discover_profile")
def discover_profile(spark, sf_dir):
    return _cands_out(D.discover_profile(_planned(spark, sf_dir), _serp(spark, sf_dir)))


@job("discover_listing")
def discover_listing(spark, sf_dir):
    return _cands_out(D.discover_listing(_planned(spark, sf_dir), _serp(spark, sf_dir)))


@job("discover_intent")
def discover_intent(spark, sf_dir):
    return _cands_out(D.discover_intent(_planned(spark, sf_dir), _serp(spark, sf_dir)))


@job("discover_places")
def discover_places(spark, sf_dir):
    return _cands_out(D.discover_places(_planned(spark, sf_dir), _fx(spark, sf_dir, "places")))


def _channels(spark, sf_dir):
    return D.discover_channels(_planned(spark, sf_dir), _serp(spark, sf_dir), _fx(spark, sf_dir, "places"),
                               _fx(spark, sf_dir, "known"))


@job("discover_channels")
def discover_channels(spark, sf_dir):
    return _cands_out(_channels(spark, sf_dir))


@job("per_channel_counts")
def per_channel_counts(spark, sf_dir):
    c = D.per_channel_counts(_channels(spark, sf_dir), _planned(spark, sf_dir), _fx(spark, sf_dir, "known"))
    return c.select(big("spec_ord").alias("spec_ord"), "channel", "kept")


def _merged(spark, sf_dir):
    c = D.exclude_known(_channels(spark, sf_dir), _fx(spark, sf_dir, "known"))
    return D.merge_candidates(c)


@job("merge_candidates")
def merge_candidates(spark, sf_dir):
    m = _merged(spark, sf_dir)
    return m.select(big("spec_ord").alias("spec_ord"), "domain", "name", "website", "query", "phone",
                    "description", joined("channels").alias("channels"))


@job("cap_candidates")
def cap_candidates(spark, sf_dir):
    c = D.cap_candidates(_merged(spark, sf_dir), _specs(spark, sf_dir))
    return c.select(big("spec_ord").alias("spec_ord"), "domain", big("cand_rank").alias("cand_rank"),
                    joined("channels").alias("channels"))


# ---------------------------------------------------------------- enrichment and leads

def _capped(spark, sf_dir):
    return D.cap_candidates(_merged(spark, sf_dir), _specs(spark, sf_dir)).checkpoint()


def _lead_out(df: DataFrame) -> DataFrame:
    return df.select(
        big("spec_ord").alias("spec_ord"), "domain", "name", "website", "query",
        joined("channels").alias("channels"), big("score").alias("score"),
        joined("score_reasons").alias("reasons"),
        joined("outreach.emails").alias("emails"), joined("outreach.phones").alias("phones"),
        joined("outreach.socials").alias("socials"), F.col("outreach.contact_url").alias("contact_url"),
        F.col("outreach").isNotNull().alias("has_outreach"), F.col("seo").isNotNull().alias("has_seo"),
        big("seo.opportunity_score").alias("opportunity_score"), joined("seo.issues").alias("issues"))


@job("enrich")
def enrich(spark, sf_dir):
    e = EN.enrich(_capped(spark, sf_dir), _fx(spark, sf_dir, "home_pages"))
    return e.select(big("spec_ord").alias("spec_ord"), "domain", F.col("outreach").isNotNull().alias("enriched"),
                    joined("outreach.emails").alias("emails"), joined("outreach.phones").alias("phones"),
                    joined("outreach.socials").alias("socials"), F.col("outreach.contact_url").alias("contact_url"),
                    big("seo.opportunity_score").alias("opportunity_score"), "brand")


@job("fold_phone")
def fold_phone(spark, sf_dir):
    from leadlake.functions import contacts as CC
    e = EN.enrich(_capped(spark, sf_dir), _fx(spark, sf_dir, "home_pages"))
    f = CC.fold_phone(F.col("outreach"), F.col("phone"))
    return e.select(big("spec_ord").alias("spec_ord"), "domain", "phone", joined(f["phones"]).alias("phones"),
                    f.isNotNull().alias("has_outreach"))


@job("build_leads")
def build_leads(spark, sf_dir):
    return _lead_out(EN.build_leads(_capped(spark, sf_dir), _fx(spark, sf_dir, "home_pages")))


@job("build_leads_no_enrich")
def build_leads_no_enrich(spark, sf_dir):
    return _lead_out(EN.build_leads(_capped(spark, sf_dir), None, enrich_pages=False))


@job("run_search")
def run_search(spark, sf_dir):
    r = EN.run_search(_specs(spark, sf_dir), _serp(spark, sf_dir), _fx(spark, sf_dir, "places"),
                      _fx(spark, sf_dir, "home_pages"), _fx(spark, sf_dir, "known"))
    return _lead_out(r).orderBy("spec_ord", F.col("score").desc())


@job("run_discovery")
def run_discovery(spark, sf_dir):
    r = EN.run_search(_specs(spark, sf_dir), _serp(spark, sf_dir), _fx(spark, sf_dir, "places"),
                      _fx(spark, sf_dir, "home_pages"), _fx(spark, sf_dir, "known"), cross_spec=True)
    return _lead_out(r)


@job("score_band")
def score_band(spark, sf_dir):
    from leadlake.functions.scoring import score_band as sb
    s = P.score_pages(_pages(spark, sf_dir))
    return s.select("page_id", big("score").alias("score"), sb(F.col("score")).alias("band"))


# ---------------------------------------------------------------- lead table maintenance

from leadlake.operators import store as ST  # noqa: E402
from leadlake.operators import views as V  # noqa: E402


def _sfx(spark, sf_dir, name):
    builders = {"leads": FX.leads, "new_leads": FX.new_leads, "patches": FX.patches, "delete_ids": FX.delete_ids,
                "searches": FX.searches, "new_searches": FX.new_searches, "runs": FX.runs}
    return FX.materialized(spark, sf_dir, name, builders[name])


def tstr(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _lead_rows(df: DataFrame) -> DataFrame:
    return df.select(
        "id", "name", "domain", "website", "description", "query", joined("channels").alias("channels"),
        joined("outreach.emails").alias("emails"), joined("outreach.phones").alias("phones"),
        joined("outreach.socials").alias("socials"), F.col("outreach.contact_url").alias("contact_url"),
        joined(F.transform("outreach.people", lambda p: F.concat_ws("/", p["name"], p["role"]))).alias("people"),
        big("seo.opportunity_score").alias("seo_opportunity"), big("score").alias("score"),
        big("opportunity_score").alias("opportunity_score"), big("issues_count").alias("issues_count"),
        "has_email", joined("score_reasons").alias("reasons"), "status", "notes", "run_id",
        tstr("created_at").alias("created_at"), tstr("updated_at").alias("updated_at"))


@job("merge_outreach")
def merge_outreach(spark, sf_dir):
    o = _sfx(spark, sf_dir, "leads").select("domain", F.col("outreach").alias("prev"))
    n = _sfx(spark, sf_dir, "new_leads").select("domain", F.col("outreach").alias("next"))
    m = o.join(n, "domain", "full_outer").select("domain", ST.merge_outreach(F.col("prev"), F.col("next")).alias("m"))
    return m.select("domain", F.col("m").isNotNull().alias("present"), joined("m.emails").alias("emails"),
                    joined("m.phones").alias("phones"), joined("m.socials").alias("socials"),
                    F.col("m.contact_url").alias("contact_url"),
                    joined(F.transform("m.people", lambda p: F.concat_ws("/", p["name"], p["role"]))).alias("people"))


@job("upsert_leads")
def upsert_leads(spark, sf_dir):
    u = ST.upsert_leads(_sfx(spark, sf_dir, "leads"), _sfx(spark, sf_dir, "new_leads"), 9, FX.NOW)
    return _lead_rows(u)


@job("known_domains")
def known_domains(spark, sf_dir):
    return ST.known_domains(_sfx(spark, sf_dir, "leads"))


@job("patch_leads")
def patch_leads(spark, sf_dir):
    out, _ = ST.patch_leads(_sfx(spark, sf_dir, "leads"), _sfx(spark, sf_dir, "patches"), FX.NOW)
    return out.select("id", "status", "notes", tstr("updated_at").alias("updated_at"))


@job("patch_leads_rejected")
def patch_leads_rejected(spark, sf_dir):
    _, rej = ST.patch_leads(_sfx(spark, sf_dir, "leads"), _sfx(spark, sf_dir, "patches"), FX.NOW)
    return rej.select("id", "status")


@job("delete_leads")
def delete_leads(spark, sf_dir):
    rem, _ = ST.delete_leads(_sfx(spark, sf_dir, "leads"), _sfx(spark, sf_dir, "delete_ids"))
    return rem.select("id", "domain")


@job("delete_leads_count")
def delete_leads_count(spark, sf_dir):
    _, n = ST.delete_leads(_sfx(spark, sf_dir, "leads"), _sfx(spark, sf_dir, "delete_ids"))
    return n


@job("cleanup_leads")
def cleanup_leads(spark, sf_dir):
    out, _, _ = ST.cleanup_leads(_sfx(spark, sf_dir, "leads"), FX.NOW)
    return out.select("id", "name", tstr("updated_at").alias("updated_at"))


@job("cleanup_deleted")
def cleanup_deleted(spark, sf_dir):
    _, d, _ = ST.cleanup_leads(_sfx(spark, sf_dir, "leads"), FX.NOW)
    return d


@job("cleanup_renamed")
def cleanup_renamed(spark, sf_dir):
    _, _, r = ST.cleanup_leads(_sfx(spark, sf_dir, "leads"), FX.NOW)
    return r


def _search_rows(df):
    return df.select("id", "niche", "location", big("lim").alias("lim"), joined("channels").alias("channels"),
                     "label", "active", tstr("created_at").alias("created_at"))


@job("upsert_searches")
def upsert_searches(spark, sf_dir):
    return _search_rows(ST.upsert_searches(_sfx(spark, sf_dir, "searches"), _sfx(spark, sf_dir, "new_searches"),
                                           FX.NOW))


@job("set_search_active")
def set_search_active(spark, sf_dir):
    s = _sfx(spark, sf_dir, "searches")
    ids = s.where(F.col("id") % 3 == 0).select("id")
    return ST.set_search_active(s, ids, False).select("id", "active")


@job("delete_searches")
def delete_searches(spark, sf_dir):
    s = _sfx(spark, sf_dir, "searches")
    return ST.delete_searches(s, s.where(F.col("id") % 4 == 1).select("id")).select("id")


@job("list_searches")
def list_searches(spark, sf_dir):
    s = ST.list_searches(_sfx(spark, sf_dir, "searches"), active_only=True)
    return s.select("id", tstr("created_at").alias("created_at"))


@job("start_finish_run")
def start_finish_run(spark, sf_dir):
    r, rid = ST.start_run(_sfx(spark, sf_dir, "runs"), 4, True, FX.NOW)
    r = ST.finish_run(r, rid, 42, "1999-06-15 12:05:00")
    r = ST.finish_run(r, 5, 1, "1999-06-15 12:06:00", error="failed again")
    return r.select("id", tstr("started_at").alias("started_at"), tstr("finished_at").alias("finished_at"),
                    "status", big("search_count").alias("search_count"), big("lead_count").alias("lead_count"),
                    "enrich", "error")


@job("list_runs")
def list_runs(spark, sf_dir):
    r = ST.list_runs(_sfx(spark, sf_dir, "runs"), limit=10)
    return r.select("id", "status")


# ---------------------------------------------------------------- views

def _leads(spark, sf_dir):
    return _sfx(spark, sf_dir, "leads")


def _ids(df):
    return df.select("id")


@job("filter_status")
def filter_status(spark, sf_dir):
    return _ids(_leads(spark, sf_dir).where(V.filter_status("qualified")))


@job("filter_min_score")
def filter_min_score(spark, sf_dir):
    return _ids(_leads(spark, sf_dir).where(V.filter_min_score(70)))


@job("filter_has_email")
def filter_has_email(spark, sf_dir):
    return _ids(_leads(spark, sf_dir).where(V.filter_has_email()))


@job("filter_text")
def filter_text(spark, sf_dir):
    return _ids(_leads(spark, sf_dir).where(V.filter_text("PLUMB")))


@job("filter_channel")
def filter_channel(spark, sf_dir):
    return _ids(_leads(spark, sf_dir).where(V.filter_channel("g2")))


@job("filter_period")
def filter_period(spark, sf_dir):
    l = _leads(spark, sf_dir)
    out = None
    for p in ("today", "yesterday", "week", "month", "year"):
        x = l.where(V.filter_period(p, FX.NOW, "UTC")).select(F.lit(p).alias("period"), "id")
        out = x if out is None else out.unionByName(x)
    x = l.where(V.filter_period("today", FX.NOW, "America/Chicago")).select(F.lit("today_chicago").alias("period"), "id")
    return out.unionByName(x)


@job("filter_date_range")
def filter_date_range(spark, sf_dir):
    return _ids(_leads(spark, sf_dir).where(V.filter_date_range("1996-01-01", "1996-12-31")))


@job("list_leads")
def list_leads(spark, sf_dir):
    """Filtered and sorted by opportunity (a distributed range sort, no global window)."""
    f = V.LeadFilter(min_score=20, has_email=False, channel="web", sort="opportunity")
    return V.list_leads(_leads(spark, sf_dir), f, FX.NOW).select("id", big("opportunity_score").alias("opportunity_score"))


@job("list_leads_recent")
def list_leads_recent(spark, sf_dir):
    f = V.LeadFilter(status="new", sort="recent")
    return V.list_leads(_leads(spark, sf_dir), f, FX.NOW).select("id", tstr("updated_at").alias("updated_at"))


@job("list_leads_name")
def list_leads_name(spark, sf_dir):
    f = V.LeadFilter(q="c", period="year", sort="name")
    return V.list_leads(_leads(spark, sf_dir), f, FX.NOW).select("id", "name")


@job("top_leads")
def top_leads(spark, sf_dir):
    return V.top_leads(_leads(spark, sf_dir), 6).select("id", big("score").alias("score"))


@job("lead_stats")
def lead_stats(spark, sf_dir):
    s = V.lead_stats(_leads(spark, sf_dir), _sfx(spark, sf_dir, "searches"), _sfx(spark, sf_dir, "runs"))
    return s.select("total_leads", "avg_score", "hot_leads", "with_email", "active_searches", "total_runs",
                    tstr("last_run_at").alias("last_run_at"))


@job("status_counts")
def status_counts(spark, sf_dir):
    s = V.status_counts(_leads(spark, sf_dir))
    return s.select("status", "n", F.round("share", 6).alias("share"))


@job("filtered_summary")
def filtered_summary(spark, sf_dir):
    l = _leads(spark, sf_dir).where(V.filter_channel("linkedin"))
    return V.filtered_summary(l)


@job("export_view")
def export_view(spark, sf_dir):
    l = _leads(spark, sf_dir)
    return V.export_view(l.where(V.filter_min_score(10))).withColumn("id", F.lit(0)).drop("id")


@job("primary_contact")
def primary_contact(spark, sf_dir):
    return V.primary_contact(_leads(spark, sf_dir))


@job("research_links")
def research_links(spark, sf_dir):
    return V.research_links(_leads(spark, sf_dir))


@job("audit_checklist")
def audit_checklist(spark, sf_dir):
    return V.audit_checklist(_leads(spark, sf_dir)).select("id", big("pos").alias("pos"), "label", "ok")


# ---------------------------------------------------------------- sources and sinks

import uuid  # noqa: E402

from leadlake.session import work_dir  # noqa: E402
from leadlake.sources import dims as DM  # noqa: E402
from leadlake.sources import readers as RD  # noqa: E402
from leadlake.sources import schemas as SC  # noqa: E402
from leadlake.sources import sinks as SK  # noqa: E402
from leadlake.streaming import streams as SS  # noqa: E402


def _scratch(spark, name):
    return work_dir(spark, f"runs/{name}-{uuid.uuid4().hex[:10]}")


@job("read_pages")
def read_pages_job(spark, sf_dir):
    p = read_pages(spark, f"{sf_dir}/pages.parquet")
    return p.select("page_id", "url", F.md5("html").alias("html_md5"), big(F.length("html")).alias("html_chars"))


@job("read_serp")
def read_serp_job(spark, sf_dir):
    FX.materialized(spark, sf_dir, "serp_json", FX.serp_payloads, fmt="json")
    s = RD.read_serp(spark, FX.fixture_path(spark, sf_dir, "serp_json"))
    return s.select(big("provider_ord").alias("provider_ord"), "query", big("rank").alias("rank"), "url", "title",
                    "description")


@job("read_places")
def read_places_job(spark, sf_dir):
    FX.materialized(spark, sf_dir, "places_json", FX.places_payloads, fmt="json")
    p = RD.read_places(spark, FX.fixture_path(spark, sf_dir, "places_json"))
    return p.select("query", big("page_no").alias("page_no"), big("pos").alias("pos"),
                    F.col("p.displayName.text").alias("name_text"), F.col("p.websiteUri").alias("website_uri"),
                    F.col("p.nationalPhoneNumber").alias("national_phone"), F.col("p.rating").alias("rating"))


@job("load_store")
def load_store_job(spark, sf_dir):
    FX.materialized(spark, sf_dir, "store_json", FX.store_documents, fmt="json")
    _, _, l = SK.load_store(spark, FX.fixture_path(spark, sf_dir, "store_json"), multi_line=False)
    return _lead_rows(l)


@job("load_store_searches")
def load_store_searches(spark, sf_dir):
    FX.materialized(spark, sf_dir, "store_json", FX.store_documents, fmt="json")
    s, r, _ = SK.load_store(spark, FX.fixture_path(spark, sf_dir, "store_json"), multi_line=False)
    return _search_rows(s)


@job("save_table")
def save_table_job(spark, sf_dir):
    root = _scratch(spark, "tables")
    l = _sfx(spark, sf_dir, "leads")
    SK.save_table(l, root, "leads", 1)
    try:
        SK.save_table(l.where(F.col("id") % 2 == 0), root, "leads", 1)
    except FileExistsError:
        pass  # a version is written once
    else:
        raise AssertionError("version 1 was written twice")
    return SK.read_table(spark, root, "leads", SC.STORED_LEAD).select("id", "domain")


@job("export_leads_csv")
def export_leads_csv_job(spark, sf_dir):
    path = _scratch(spark, "export") + "/leads.csv"
    v = V.export_view(V.list_leads(_leads(spark, sf_dir), V.LeadFilter(min_score=10)))
    SK.export_leads_csv(v, path)
    back = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("nullValue", "\u0000").option("emptyValue", "").csv(path))
    return back.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in back.columns])


@job("exclude_blocked")
def exclude_blocked_job(spark, sf_dir):
    h = _hit_hosts(spark, sf_dir).where(F.col("host").isNotNull()).select("host").distinct()
    a = D.exclude_blocked(h, "host", DM.blocklist(spark, "aggregator"), prefixes=True)
    return D.exclude_blocked(a, "host", DM.blocklist(spark, "microsite"), prefixes=False)


# ---------------------------------------------------------------- streaming

def _await(q):
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


@job("stream_enrich")
def stream_enrich_job(spark, sf_dir):
    base = _scratch(spark, "stream-enrich")
    src = base + "/in"
    read_pages(spark, f"{sf_dir}/pages.parquet").repartition(4).write.parquet(src)
    st = spark.readStream.schema(SC.PAGES).option("maxFilesPerTrigger", 2).parquet(src)
    out = SS.stream_enrich(st)
    q = (out.writeStream.format("parquet").option("path", base + "/out")
         .option("checkpointLocation", base + "/ckpt").trigger(availableNow=True).start())
    _await(q)
    s = spark.read.parquet(base + "/out")
    return s.select(
        "page_id", "url", big("score").alias("score"), big("seo.opportunity_score").alias("opportunity_score"),
        big(F.size("seo.issues")).alias("issues_count"), joined("seo.issues").alias("issues"),
        joined("score_reasons").alias("reasons"), joined("outreach.emails").alias("emails"),
        joined("outreach.phones").alias("phones"), joined("outreach.socials").alias("socials"))


@job("stream_new_domains")
def stream_new_domains_job(spark, sf_dir):
    base = _scratch(spark, "stream-domains")
    second = F.pmod(F.xxhash64("query", "provider_ord", "rank"), F.lit(3 * 3600))
    hits = _serp(spark, sf_dir).select("url", F.timestamp_seconds(F.lit(1704067200) + second).alias("ts"),
                                       F.floor(second / 3600).alias("hour"))
    # three hours of hits, appended one after another; the watermark outlasts them
    for i in range(3):
        hits.where(F.col("hour") == i).select("url", "ts").write.mode("append").parquet(base + "/in")
    st = spark.readStream.schema("url string, ts timestamp").option("maxFilesPerTrigger", 8).parquet(base + "/in")
    out = SS.stream_new_domains(st, _fx(spark, sf_dir, "known"), delay="6 hours")
    q = (out.select("domain").writeStream.format("parquet").option("path", base + "/out")
         .option("checkpointLocation", base + "/ckpt").trigger(availableNow=True).start())
    _await(q)
    return spark.read.parquet(base + "/out").select("domain")


@job("stream_upsert")
def stream_upsert_job(spark, sf_dir):
    base = _scratch(spark, "stream-upsert")
    nl = _sfx(spark, sf_dir, "new_leads")
    # three ranges of domains, so that the ids follow the domains over all batches
    t = nl.repartitionByRange(3, "domain").withColumn("_o", F.spark_partition_id()).checkpoint()
    for i in range(3):
        t.where(F.col("_o") == i).drop("_o").write.mode("append").parquet(base + "/in")
    st = spark.readStream.schema(SC.LEAD).option("maxFilesPerTrigger", 1).parquet(base + "/in")
    q = SS.stream_upsert(st, base + "/tables", _sfx(spark, sf_dir, "leads"), 9, FX.NOW, base + "/ckpt", buckets=8)
    _await(q)
    return _lead_rows(SS.latest_store(spark, base + "/tables"))


@job("stream_sessions")
def stream_sessions_job(spark, sf_dir):
    base, events = _scratch(spark, "stream-sessions"), _events(spark, sf_dir)
    st = _replayed(spark, events, base)
    q = (SS.stream_sessions(st, "user_id", "ts", SESSION_GAP, "1 hour", *_session_sums()).writeStream.format("parquet")
         .option("path", base + "/out").option("checkpointLocation", base + "/ckpt").trigger(availableNow=True).start())
    _await(q)
    return _session_rows(spark.read.parquet(base + "/out").where(F.col("user_id").isNotNull()))


@job("stream_follow_ups")
def stream_follow_ups_job(spark, sf_dir):
    base, events = _scratch(spark, "stream-follow-ups"), _events(spark, sf_dir)
    opens, closes = _follow_ups()
    q = (SS.stream_unanswered(_replayed(spark, events, base), "user_id", "ts", opens, closes, 48 * 3600, "1 hour").writeStream.format("parquet")
         .option("path", base + "/out").option("checkpointLocation", base + "/ckpt").trigger(availableNow=True).start())
    _await(q)
    return _follow_up_rows(spark.read.parquet(base + "/out"))


# ---------------------------------------------------------------- time: as-of, interval, sessions, follow-ups

from leadlake.operators import history as HI  # noqa: E402
from leadlake.operators import summaries as SU  # noqa: E402
from leadlake.operators import timeline as TL  # noqa: E402

SESSION_GAP = "6 hours"
_EVENT_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def micros(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def _events(spark, sf_dir):
    return FX.table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")


def _in_event_time(c):
    """Order dates (years) moved into the month of the events."""
    return F.timestamp_seconds(F.lit(1704067200) + F.floor((F.unix_seconds(c.cast("timestamp")) - 788918400) / 81))


def _orders(spark, sf_dir):
    o = FX.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", _in_event_time(F.col("o_orderdate")).alias("placed_at"))
    return o.withColumnRenamed("o_custkey", "user_id")


def _replayed(spark, events, base):
    """The events as a stream: four ranges of time appended one after another, then a far row of no user, which
    moves the watermark past everything that is open."""
    day = F.dayofmonth("ts")
    for i, (a, b) in enumerate(((1, 9), (9, 17), (17, 25), (25, 32))):
        events.where((day >= a) & (day < b)).write.mode("append").parquet(base + "/in")
    end = spark.createDataFrame([(None, None, None, None, None)], _EVENT_SCHEMA).withColumn("ts", F.lit("2030-01-01 00:00:00").cast("timestamp"))
    end.write.mode("append").parquet(base + "/in")
    return spark.readStream.schema(_EVENT_SCHEMA).option("maxFilesPerTrigger", 4).parquet(base + "/in")


@job("asof_join")
def asof_join_job(spark, sf_dir):
    j = TL.asof_join(_events(spark, sf_dir).select("event_id", "user_id", "ts"), _orders(spark, sf_dir), "user_id", "ts", "placed_at",
                     ["o_orderkey", "o_totalprice", "placed_at"], "o_orderkey")
    return j.select("event_id", "user_id", "o_orderkey", "o_totalprice", tstr("placed_at").alias("placed_at"))


@job("last_touch")
def last_touch(spark, sf_dir):
    """The last click before each purchase."""
    e = _events(spark, sf_dir)
    clicks = e.where(F.col("event_type") == "click").select("user_id", F.col("ts").alias("clicked_at"), F.col("event_id").alias("click_id"))
    j = TL.asof_join(e.where(F.col("event_type") == "purchase").select("event_id", "user_id", "ts", "value"), clicks, "user_id", "ts", "clicked_at",
                     ["click_id", "clicked_at"], "click_id", strict=True)
    return j.select("event_id", "user_id", "value", "click_id", micros("clicked_at").alias("clicked_at"))


@job("interval_join")
def interval_join_job(spark, sf_dir):
    """Orders that are open (until the last of their lines is shipped) while their customer does something."""
    shipped = FX.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("s"))
    o = _orders(spark, sf_dir).join(shipped, "o_orderkey").select("o_orderkey", "user_id", "placed_at", _in_event_time(F.col("s")).alias("closed_at"))
    e = _events(spark, sf_dir).select("event_id", "user_id", "ts")
    return TL.interval_join(o, e, ["user_id"], ("placed_at", "closed_at"), ("ts", "ts")).select("o_orderkey", "event_id", "user_id")


def _session_sums():
    return F.sum("value").alias("total"), F.min("event_id").alias("first_event")


def _session_rows(s):
    return s.select("user_id", micros("session_start").alias("session_start"), micros("session_end").alias("session_end"), "n_events",
                    F.round("total", 4).alias("total"), "first_event")


@job("session_windows")
def session_windows(spark, sf_dir):
    return _session_rows(TL.sessions(_events(spark, sf_dir), "user_id", "ts", SESSION_GAP, *_session_sums()))


def _follow_ups():
    return F.col("event_type") == "signup", F.col("event_type") == "purchase"


def _follow_up_rows(f):
    return f.select("user_id", micros("opened_at").alias("opened_at"), micros("due_at").alias("due_at"))


@job("follow_ups")
def follow_ups(spark, sf_dir):
    """Sign-ups that no purchase of the user follows within two days."""
    return _follow_up_rows(TL.unanswered(_events(spark, sf_dir), "user_id", "ts", *_follow_ups(), "48 hours"))


# ---------------------------------------------------------------- subtotals, sketches, ranks, history

def _placed_leads(spark, sf_dir):
    geo = _geo(spark, sf_dir)
    c = FX.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = geo.select(F.regexp_replace("state_code", "^N", "").cast("int").alias("c_nationkey"), "country", "state").distinct()
    city = F.when(F.col("c_custkey") % 11 != 0, F.concat(F.lit("City "), (F.col("c_custkey") % 5).cast("string")))
    places = c.join(n, "c_nationkey").select(F.col("c_custkey").alias("id"), "country", "state", city.alias("city"))
    return _leads(spark, sf_dir).join(places, "id")


@job("lead_funnel")
def lead_funnel(spark, sf_dir):
    f = SU.lead_funnel(_placed_leads(spark, sf_dir), ["country", "state", "city"])
    return f.withColumn("avg_score", F.round("avg_score", 6)).withColumn("grouping_id", big("grouping_id"))


@job("lead_cube")
def lead_cube(spark, sf_dir):
    from leadlake.functions.scoring import score_band as sb
    each = _leads(spark, sf_dir).select(F.explode_outer("channels").alias("channel"), "status", sb(F.col("score")).alias("band"), "score", "has_email")
    c = SU.lead_cube(each, ["channel", "status", "band"])
    return c.withColumn("avg_score", F.round("avg_score", 6)).withColumn("grouping_id", big("grouping_id"))


@job("distinct_sketches")
def distinct_sketches(spark, sf_dir):
    """Sketches of the domains of each provider and hour, stored, then merged over the hours; close to the exact counts."""
    hour = F.pmod(F.xxhash64("query", "rank"), F.lit(24))
    hits = _serp(spark, sf_dir).select("provider_ord", hour.alias("hour"), U.host_of(F.col("url")).alias("domain"))
    root = _scratch(spark, "sketches")
    SK.save_table(SU.distinct_sketches(hits, ["provider_ord", "hour"], "domain"), root, "domains", 1)
    stored = spark.read.parquet(f"{root}/domains/v=1")
    merged = SU.merged_sketches(stored, ["provider_ord"]).select("provider_ord", SU.distinct_estimate().alias("estimate"))
    exact = hits.groupBy("provider_ord").agg(F.count_distinct("domain").alias("domains"))
    return merged.join(exact, "provider_ord").select(big("provider_ord").alias("provider_ord"), "domains",
                                                     (F.abs(F.col("estimate") - F.col("domains")) <= 1 + 0.06 * F.col("domains")).alias("close"))


@job("global_ntile")
def global_ntile(spark, sf_dir):
    l = _leads(spark, sf_dir).select("id", "score")
    return SU.global_ntile(l, [F.col("score").desc(), F.col("id")], 10, "decile").select("id", big("decile").alias("decile"))


@job("quantiles")
def quantiles(spark, sf_dir):
    q = SU.quantiles(_events(spark, sf_dir), "value", [0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0])
    return q.select("probability", F.round("value", 6).alias("value"))


@job("change_history")
def change_history(spark, sf_dir):
    """Three versions of the lead table (as stored, patched, some deleted) as validity periods."""
    v0 = _leads(spark, sf_dir)
    v1, _ = ST.patch_leads(v0, _sfx(spark, sf_dir, "patches"), FX.NOW)
    v2, _ = ST.delete_leads(v1, _sfx(spark, sf_dir, "delete_ids"))
    log = HI.change_log({0: v0, 1: v1, 2: v2}, "id", ["status", "notes", "updated_at"])
    return HI.periods(log, "id").select("id", "valid_from", "valid_to", "change", "status", "notes", tstr("updated_at").alias("updated_at"))


# ---------------------------------------------------------------- payloads that drift, captures that arrive

from leadlake.sources import captures as CA  # noqa: E402
from leadlake.sources import payloads as PY  # noqa: E402


def _drifting(spark, sf_dir):
    return PY.parsed(FX.drifting_props(spark, sf_dir), "props")


@job("drifting_payloads")
def drifting_payloads(spark, sf_dir):
    t = PY.typed_fields(_drifting(spark, sf_dir), "payload", {"k": ("$.k", "long"), "ref": ("$.ref", "string"), "w": ("$.w", "double")}, "props")
    return t.select("event_id", "k", "ref", "w", "reason", joined("unknown").alias("unknown"))


@job("payload_items")
def payload_items(spark, sf_dir):
    each = PY.elements(_drifting(spark, sf_dir), "payload", "$.items")
    t = PY.typed_fields(each, "payload", {"sku": ("$.sku", "string"), "n": ("$.n", "long")})
    return t.select("event_id", big("pos").alias("pos"), "sku", "n", "reason")


@job("payload_shape")
def payload_shape_job(spark, sf_dir):
    return PY.payload_shape(_drifting(spark, sf_dir), "payload")


@job("stream_captures")
def stream_captures_job(spark, sf_dir):
    """The pages as four captures, taken in two runs of the stream; the third is closed between them."""
    base, pages = _scratch(spark, "stream-captures"), _pages(spark, sf_dir).drop("status_code")
    for i in range(4):
        part = pages.where(F.pmod("page_id", F.lit(4)) == i)
        if i == 2:
            late = part
        else:
            part.write.parquet(f"{base}/in/capture-{i}")

    def run():
        q = (CA.stream_captures(spark, f"{base}/in", "page_id long, url string, html string").writeStream.format("parquet")
             .option("path", base + "/out").option("checkpointLocation", base + "/ckpt").trigger(availableNow=True).start())
        _await(q)
    late.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{base}/in/capture-2")
    run()
    spark.range(0).write.mode("append").parquet(f"{base}/in/capture-2")  # leaves the marker
    run()
    return spark.read.parquet(base + "/out").select("page_id", "url", F.md5("html").alias("html_md5"))
