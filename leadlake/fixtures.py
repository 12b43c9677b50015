"""Derived test tables (FIXTURES.md §2), built from the base tables with Spark.

Each fixture is deterministic arithmetic on keys of a base table, so its size
grows with the base table. The DuckDB oracle builds the same tables
independently in SQL (``oracle/fixtures_sql.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake import constants as K


FILES = 16  # files of a fixture: the base tables are single files of one row group


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stamp(spark: SparkSession, sf_dir: str) -> str:
    """A key of the input files (names, sizes, times), listed by the file system that Spark reads."""
    import hashlib

    from leadlake.session import _fs
    fs, folder = _fs(spark, sf_dir)
    files = sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime() // 1000}" for f in fs.listStatus(folder))
    return hashlib.sha1("\n".join([fs.makeQualified(folder).toString(), *files]).encode()).hexdigest()[:16]


def materialized(spark: SparkSession, sf_dir: str, name: str, build, fmt: str = "parquet", by: tuple[str, ...] = ()) -> DataFrame:
    """A derived fixture written once as Parquet under the session's shared
    checkpoint folder (keyed by the input files), then read back. Cuts the
    fixture's lineage out of every job that uses it. ``by``: columns that deal the rows to
    the files; without them they are dealt in turn, for which Spark sorts the whole rows of a task."""
    from leadlake.session import configure, publish_table, table_exists, work_dir
    configure(spark)
    path = work_dir(spark, f"fixtures/{_stamp(spark, sf_dir)}/{name}")
    if not table_exists(spark, path):
        publish_table(build(spark, sf_dir).repartition(FILES, *by), path, fmt)
    return spark.read.parquet(path) if fmt == "parquet" else None


def fixture_path(spark: SparkSession, sf_dir: str, name: str) -> str:
    from leadlake.session import work_dir
    return work_dir(spark, f"fixtures/{_stamp(spark, sf_dir)}/{name}")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base pages, read once from their single row group (one task) and dealt to several files."""
    return materialized(spark, sf_dir, "pages", lambda s, d: table(s, d, "pages"), by=("page_id", "url"))


def _s(c: Column) -> Column:
    return c.cast("string")


def rich_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_rich_pages``: one HTML page per document with every SEO signal
    varied by ``doc_id`` (title/description lengths, og tags, favicon, H1,
    social/external/relative/fragment/mailto links, HTTP errors)."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    i = F.col("doc_id")
    clean = F.regexp_replace(F.col("text"), "[\"'<>]", "")
    host = F.concat(F.lit("d"), _s(i), F.lit(".example.com"))
    url = F.when(i % 2 == 0, F.concat(F.lit("https://"), host, F.lit("/"))) \
           .otherwise(F.concat(F.lit("http://"), host, F.lit("/home")))
    title = F.concat(F.when(i % 6 == 0, F.lit("# ")).otherwise(F.lit("")),
                     clean.substr(F.lit(1), (i % 90).cast("int")))
    desc = clean.substr(F.lit(1), (i % 200).cast("int"))
    meta_desc = (F.when((i % 200 > 0) & (i % 2 == 0),
                        F.concat(F.lit('<meta name="description" content="'), desc, F.lit('">')))
                 .when(i % 200 > 0, F.concat(F.lit('<meta content="'), desc, F.lit('" name="description">')))
                 .otherwise(F.lit("")))
    og_title = F.when(i % 3 == 0, F.concat(F.lit('<meta property="og:title" content="'),
                                             clean.substr(F.lit(1), F.lit(40)), F.lit('">'))).otherwise(F.lit(""))
    og_image = F.when(i % 4 == 0, F.concat(F.lit('<meta property="og:image" content="/img/'), _s(i),
                                             F.lit('.png">'))).otherwise(F.lit(""))
    fav = F.when(i % 5 == 0, F.lit('<meta name="icon" content="/favicon.ico">')).otherwise(F.lit(""))
    social = F.when(i % 2 == 0, F.concat(F.lit('<a href="https://www.linkedin.com/company/d'), _s(i),
                                           F.lit('">in</a>'))).otherwise(F.lit(""))
    lookalike = F.when(i % 3 == 1, F.concat(F.lit('<a href="https://netflix.com/title/'), _s(i),
                                              F.lit('">tv</a>'))).otherwise(F.lit(""))
    html = F.concat(
        F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), title, F.lit("</title>"),
        meta_desc, og_title, og_image, fav,
        F.lit('</head><body><nav><a href="/">Home</a><a href="/about">About</a>'
              '<a href="team/../contact?x=1">Team</a><a href="/p#frag">Skip</a>'),
        F.concat(F.lit('<a href="mailto:info@'), host, F.lit('">Mail</a>')),
        social, lookalike,
        F.concat(F.lit('<a href="//partner'), _s(i % 7), F.lit('.example.org/x/./y/../z">P</a>')),
        F.concat(F.lit('<a href="HTTP://WWW.D'), _s(i), F.lit('.EXAMPLE.COM:80/Caps">C</a>')),
        F.lit("</nav><main><p>"), F.col("text"), F.lit("</p></main></body></html>"),
    )
    status = (F.when(i % 17 == 0, F.lit(404)).when(i % 29 == 0, F.lit(500)).otherwise(F.lit(200)))
    return d.select(i.alias("page_id"), url.alias("url"), status.cast("int").alias("status_code"), html.alias("html"))


# --------------------------------------------------------------------------- discovery

# Fixture brand stems (test data of ours, not application values).
BRANDS = ["Apex", "Nova", "Summit", "Blue River", "Clay", "Bright Path", "Iron Oak", "Zenith"]
SUB_CHANNELS = {1: ["web", "quora", "googlemaps", "g2", "web", "nope"],
                3: ["linkedin", "clutch", "crunchbase", "yellowpages", "web"]}
PROFILE_PATH = {"clutch": "/profile/", "g2": "/products/", "crunchbase": "/organization/", "linkedin": "/company/"}
PROFILE_DOMAIN = {"clutch": "clutch.co", "g2": "g2.com", "crunchbase": "crunchbase.com", "linkedin": "linkedin.com"}


def _pick(arr: list[str], idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in arr]), (idx + 1).cast("int"))


def brand_of(key: Column) -> Column:
    return F.concat(_pick(BRANDS, key % len(BRANDS)), F.lit(" "), key.cast("string"))


def slug_of(brand: Column) -> Column:
    return F.lower(F.replace(brand, F.lit(" "), F.lit("")))


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_specs``: market segment x nation, with messy niches,
    limits and channel lists so every normalisation branch is hit."""
    cust = table(spark, sf_dir, "customer").select("c_mktsegment", "c_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    pairs = (cust.select(F.lower("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("n_nationkey"))
                 .distinct().join(nat, "n_nationkey"))
    from pyspark.sql import Window as W
    o = F.row_number().over(W.orderBy("seg", "n_nationkey")) - 1
    base = pairs.select(o.cast("int").alias("spec_ord"), "seg", "n_nationkey", "n_name")
    so = F.col("spec_ord")
    niche = F.when(so % 5 == 0, F.concat(F.lit("  "), F.col("seg"), F.lit(" "))).otherwise(F.col("seg"))
    loc = (F.when(F.col("n_nationkey") == 3, F.lit(None).cast("string"))
           .when(so % 7 == 2, F.lit("   "))
           .otherwise(F.concat(F.col("n_name"), F.lit(", TX"))))
    lim = (F.when(so % 7 == 0, F.lit(0)).when(so % 7 == 6, F.lit(99))
           .otherwise(5 + 5 * (F.col("n_nationkey") % 3))).cast("int")
    ch = (F.when(so % 2 == 0, F.lit(None).cast("array<string>"))
          .when(so % 4 == 1, F.array(*[F.lit(c) for c in SUB_CHANNELS[1]]))
          .otherwise(F.array(*[F.lit(c) for c in SUB_CHANNELS[3]])))
    return base.select("spec_ord", niche.alias("niche"), loc.alias("location"), lim.alias("lim"), ch.alias("channels"))


def planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered queries of all specs, written once: four fixtures are made from them."""
    return materialized(spark, sf_dir, "planned", _numbered_queries)


def _numbered_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadlake.plans.planning import normalize_specs, plan_queries
    from pyspark.sql import Window as W
    q = plan_queries(normalize_specs(specs(spark, sf_dir)))
    return q.withColumn("query_no", (F.row_number().over(W.orderBy("spec_ord", "channel_ord", "query_ord")) - 1)
                        .cast("long"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from leadlake.functions.html import extract_title
    return pages(spark, sf_dir).select("page_id", "url", F.coalesce(extract_title(F.col("html")),
                                                                             F.lit("")).alias("ptitle"))


def serp(spark: SparkSession, sf_dir: str, assigned: DataFrame | None = None) -> DataFrame:
    """``fx_serp``: every page is a hit of 12 web/intent/listing queries; some
    urls are aggregators, microsites or malformed; titles vary by page; queries
    with ``gno % 3 = 0`` have no results from provider 0."""
    from pyspark.sql import Window as W
    h = _serp_assign(spark, sf_dir) if assigned is None else assigned
    pid = F.col("page_id")
    url = (F.when(pid % 11 == 0, F.concat(F.lit("https://www.yelp.com/biz/p"), pid.cast("string")))
           .when(pid % 11 == 1, F.concat(F.lit("https://p"), pid.cast("string"), F.lit(".square.site/")))
           .when(pid % 11 == 2, F.concat(F.lit("notaurl p"), pid.cast("string")))
           .otherwise(F.col("url")))
    t = F.col("ptitle")
    title = (F.when(pid % 7 == 0, F.concat(F.lit("Top 10 "), t))
             .when(pid % 7 == 1, F.concat(F.lit("Home - "), t))
             .when(pid % 7 == 2, F.concat(t, F.lit(" | Brand")))
             .when(pid % 7 == 3, F.concat(t, F.lit(", TX")))
             .when(pid % 7 == 4, F.lit(""))
             .otherwise(t))
    b1, b2 = brand_of(pid), brand_of(pid + 1)
    desc = F.when(F.col("channel") == "yellowpages", F.concat(
        F.lit("Austin, TX 78701. "), b1, F.lit(" - Plumbers, open now. 1200 Main St. Call today. From Business: "),
        b2, F.lit(" is a family company."))).otherwise(F.concat(F.lit("Snippet "), pid.cast("string")))
    prov = F.when(F.col("gno") % 3 == 0, 1 + F.col("j") % 2).otherwise(F.col("j") % 2).cast("int")
    out = h.select(prov.alias("provider_ord"), "query", url.alias("url"), title.alias("title"),
                   desc.alias("description"), "page_id", "j")
    rank = F.row_number().over(W.partitionBy("query", "provider_ord").orderBy("page_id", "j"))
    return out.select("provider_ord", "query", rank.cast("int").alias("rank"), "url", "title", "description")


def _serp_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page -> query assignment of ``fx_serp`` (12 hits per page)."""
    from pyspark.sql import Window as W
    q = planned(spark, sf_dir).where(F.col("channel").isin("web", "quora", "yellowpages"))
    qn = q.select("query", "channel", "location",
                  (F.row_number().over(W.orderBy("query_no")) - 1).cast("long").alias("gno"))
    n = qn.count()
    p = page_titles(spark, sf_dir)
    pid = F.col("page_id")
    hits = p.select("page_id", "url", "ptitle", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("j"))
    hits = hits.withColumn("gno", ((pid * 7 + F.col("j") * 13) % F.lit(n)).cast("long"))
    return hits.join(F.broadcast(qn), "gno")  # as many rows as the specs have queries


def _profile_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier -> profile query assignment of ``fx_profile_hits`` (4 per supplier)."""
    from pyspark.sql import Window as W
    q = planned(spark, sf_dir).where(F.col("channel").isin("clutch", "g2", "crunchbase", "linkedin"))
    qn = q.select("query", "channel", "location",
                  (F.row_number().over(W.orderBy("query_no")) - 1).cast("long").alias("pno"))
    n = qn.count()
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k")
    return (s.select("k", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
             .withColumn("pno", ((k * 3 + F.col("j") * 7) % F.lit(n)).cast("long")).join(F.broadcast(qn), "pno"))


def profile_hits(spark: SparkSession, sf_dir: str, assigned: DataFrame | None = None) -> DataFrame:
    """``fx_profile_hits``: suppliers as profile pages on the channel domains, with
    sub-domain and ``/compare`` rows mixed in and junk title suffixes."""
    from pyspark.sql import Window as W
    h = _profile_assign(spark, sf_dir) if assigned is None else assigned
    k = F.col("k")
    dom = F.col("channel")
    domain = F.coalesce(*[F.when(dom == c, F.lit(d)) for c, d in PROFILE_DOMAIN.items()])
    path = F.coalesce(*[F.when(dom == c, F.lit(p)) for c, p in PROFILE_PATH.items()])
    host = (F.when(k % 10 == 0, F.concat(F.lit("ai."), domain))
            .when(k % 10 == 2, F.concat(F.lit("www."), domain)).otherwise(domain))
    path = F.when(k % 10 == 1, F.lit("/compare/")).otherwise(path)
    url = F.concat(F.lit("https://"), host, path, F.lit("s"), k.cast("string"))
    b = brand_of(k)
    title = (F.when(k % 6 == 0, F.concat(b, F.lit(" - Overview | LinkedIn")))
             .when(k % 6 == 1, F.concat(b, F.lit(" | Clutch.co")))
             .when(k % 6 == 2, F.concat(b, F.lit(" Reviews 2024: Details, Pricing")))
             .when(k % 6 == 3, F.concat(b, F.lit(" - Crunchbase Company Profile & Funding")))
             .when(k % 6 == 4, F.concat(F.lit("Top "), b, F.lit(" Agencies")))
             .otherwise(b))
    w1 = F.concat(_pick(["Moz", "Ahrefs", "Semrush", "Ubersuggest"], k % 4), k.cast("string"))
    w2 = F.concat(F.lit("Spy"), k.cast("string"))
    desc = F.when(dom == "g2", F.concat(
        F.lit("Popular: "), b, F.lit(" · Analytics · "), brand_of(k + 1), F.lit(" (1,234) · best · tools like "),
        w1, F.lit(", "), w2, F.lit(", and Nova"), k.cast("string"))).otherwise(F.lit(""))
    rank = F.row_number().over(W.partitionBy("query").orderBy("k", "j"))
    return h.select(F.lit(0).alias("provider_ord"), "query", rank.cast("int").alias("rank"),
                    url.alias("url"), title.alias("title"), desc.alias("description"))


def resolve_hits(spark: SparkSession, sf_dir: str, profiles: DataFrame | None = None, assigned: DataFrame | None = None) -> DataFrame:
    """``fx_resolve_hits``: for every (brand, spec location) that a profile or
    listing hit can produce, the two resolution queries; hosts that match the
    name, that belong to another name, and blocked hosts."""
    pa = (_profile_assign(spark, sf_dir) if profiles is None else profiles).select("k", "location")
    sa = (_serp_assign(spark, sf_dir) if assigned is None else assigned).where(F.col("channel") == "yellowpages")
    names = (pa.unionByName(sa.select(F.col("page_id").alias("k"), "location"))
               .unionByName(sa.select((F.col("page_id") + 1).alias("k"), "location"))
               .unionByName(pa.select((F.col("k") + 1).alias("k"), "location"))
               .distinct())
    k = F.col("k")
    b = brand_of(k)
    loc = F.when(F.col("location").isNotNull(), F.concat(F.lit(" "), F.col("location"))).otherwise(F.lit(""))
    q1 = F.concat(F.lit('"'), b, F.lit('"'), loc, F.lit(" official website"))
    q2 = F.concat(b, loc, F.lit(" website"))
    slug, other = slug_of(b), slug_of(brand_of(k + 1))
    h1 = F.array(
        F.struct(F.lit(1).alias("rank"), F.concat(F.lit("https://www.yelp.com/biz/"), slug).alias("url")),
        F.struct(F.lit(2).alias("rank"),
                 F.when(k % 3 == 0, F.concat(F.lit("https://"), other, F.lit(".example.com/")))
                  .otherwise(F.concat(F.lit("https://www."), slug, F.lit(".example.com/"))).alias("url")))
    h2 = F.array(
        F.struct(F.lit(1).alias("rank"), F.concat(F.lit("https://"), slug, F.lit("-co.example.net/about")).alias("url")))
    rows = names.select(F.explode(F.array(F.struct(q1.alias("query"), h1.alias("h")),
                                          F.struct(q2.alias("query"), h2.alias("h")))).alias("x"))
    return (rows.select(F.col("x.query").alias("query"), F.explode("x.h").alias("y")).distinct()
                .select(F.lit(0).alias("provider_ord"), "query", F.col("y.rank").cast("int").alias("rank"),
                        F.col("y.url").alias("url"), F.lit("").alias("title"), F.lit("").alias("description")))


def all_serp(spark: SparkSession, sf_dir: str) -> DataFrame:
    pa, sa = _profile_assign(spark, sf_dir), _serp_assign(spark, sf_dir)
    return serp(spark, sf_dir, sa).unionByName(profile_hits(spark, sf_dir, pa)).unionByName(resolve_hits(spark, sf_dir, pa, sa))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_places``: suppliers as places of the googlemaps queries, 20 per page."""
    from pyspark.sql import Window as W
    q = planned(spark, sf_dir).where(F.col("channel") == "googlemaps").select("query").distinct()
    qn = q.select("query", (F.row_number().over(W.orderBy("query")) - 1).cast("long").alias("gno"))
    n = qn.count()
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k")
    h = s.withColumn("gno", (k % F.lit(n)).cast("long")).join(qn, "gno")
    pos0 = F.row_number().over(W.partitionBy("query").orderBy("k")) - 1
    b = brand_of(k)
    slug = slug_of(b)
    digits4 = F.lpad((k % 10000).cast("string"), 4, "0")
    place = F.struct(
        F.struct(F.when(k % 13 != 0, b).alias("text")).alias("displayName"),
        (F.when(k % 9 == 0, F.lit(None).cast("string"))
          .when(k % 9 == 1, F.concat(F.lit("https://www.yelp.com/biz/"), slug))
          .otherwise(F.concat(F.lit("https://www."), slug, F.lit(".example.com/")))).alias("websiteUri"),
        F.when(k % 4 != 0, F.concat(F.lit("(512) 555-"), digits4)).alias("nationalPhoneNumber"),
        F.concat(F.lit("+1 512-555-"), digits4).alias("internationalPhoneNumber"),
        F.when(k % 5 != 0, F.concat(k.cast("string"), F.lit(" Main St, Austin, TX"))).alias("formattedAddress"),
        F.when(k % 7 != 0, ((k % 41) + 10) / 10.0).alias("rating"),
        (k % 50).cast("long").alias("userRatingCount"),
    )
    out = h.select("query", pos0.alias("p0"), place.alias("p"))
    return out.select("query", (F.floor(F.col("p0") / 20)).cast("int").alias("page_no"),
                      (F.col("p0") % 20).cast("int").alias("pos"), "p")


def home_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_home_pages`` + ``fx_contact_pages``: per host, the lowest page is the
    home page (404 / failed fetch for some), the second lowest is ``/contact``, the
    rest are sub-pages no candidate needs."""
    from pyspark.sql import Window as W
    from leadlake.functions.urls import host_of
    p = pages(spark, sf_dir).select("page_id", "html", host_of(F.col("url")).alias("host"))
    r = F.row_number().over(W.partitionBy("host").orderBy("page_id"))
    p = p.withColumn("r", r)
    pid = F.col("page_id")
    status = (F.when(F.col("r") == 2, F.lit(200)).when(pid % 17 == 0, F.lit(404))
              .when(pid % 19 == 0, F.lit(None)).otherwise(F.lit(200))).cast("int")
    url = F.when(F.col("r") == 1, F.concat(F.lit("https://"), F.col("host"))) \
           .when(F.col("r") == 2, F.concat(F.lit("https://"), F.col("host"), F.lit("/contact"))) \
           .otherwise(F.concat(F.lit("https://"), F.col("host"), F.lit("/p"), F.col("r").cast("string")))
    return p.select(url.alias("url"), status.alias("status_code"), "html")


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_known``: hosts of every fifth page are already stored."""
    from leadlake.functions.urls import host_of
    p = pages(spark, sf_dir)
    return p.where(F.col("page_id") % 5 == 0).select(host_of(F.col("url")).alias("domain")).distinct()


# --------------------------------------------------------------------------- store

NOW = "1999-06-15 12:00:00"
NOW_EPOCH = 929448000
FALLBACK_EPOCH = 928195200  # 1999-06-01 00:00:00


def _epoch(c: Column) -> Column:
    return c.cast("timestamp").cast("long")


def _lpad4(k: Column) -> Column:
    return F.lpad((k % 10000).cast("string"), 4, "0")


def _seo_struct(k: Column, title: Column, website: Column, opp: Column, issues: Column) -> Column:
    return F.struct(
        website.alias("final_url"), F.lit(True).alias("https_ok"), F.lit(200).alias("status_code"),
        title.alias("title"), F.length(title).alias("title_length"), F.lit(None).cast("string").alias("description"),
        F.lit(0).alias("description_length"), F.lit(False).alias("has_h1"), F.lit(False).alias("has_og_title"),
        F.lit(False).alias("has_og_image"), F.lit(False).alias("has_favicon"), F.lit(100).alias("word_count"),
        issues.alias("issues"), opp.cast("int").alias("opportunity_score"))


def lead_domain(k: Column) -> Column:
    return (F.when(k % 23 == 0, F.concat(F.lit("c"), k.cast("string"), F.lit(".square.site")))
            .when((k % 10 == 0) | (k % 10 == 2), F.concat(F.lit("acme-roofing"), k.cast("string"), F.lit(".com")))
            .otherwise(F.concat(F.lit("c"), k.cast("string"), F.lit(".example.com"))))


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_leads``: one stored lead per customer; created/updated from the
    customer's first/last order (some pinned near ``NOW``)."""
    from leadlake.sources import schemas as S
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_nationkey",
                                                "c_acctbal", "c_mktsegment")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("dmin"),
                                                                F.max("o_orderdate").alias("dmax"))
    j = c.join(o, c.k == o.o_custkey, "left")
    k = F.col("k")
    name = (F.when(k % 10 == 0, F.lit("Top 10 Plumbers in Austin")).when(k % 10 == 1, F.lit("smithplumbing"))
            .when(k % 10 == 2, F.lit("Best Dentist")).when(k % 10 == 3, F.lit("familydentalandair"))
            .otherwise(F.col("c_name")))
    domain = lead_domain(k)
    website = F.concat(F.lit("https://"), domain)
    chans = F.filter(F.array(*[F.lit(x) for x in K.CHANNEL_IDS]),
                     lambda x, i: F.floor(k / F.pow(F.lit(2), i)) % 2 == 1)
    outreach = F.when(k % 11 != 0, F.struct(
        F.when(k % 3 == 0, F.array(F.concat(F.lit("info@c"), k.cast("string"), F.lit(".example.com"))))
         .otherwise(F.array().cast("array<string>")).alias("emails"),
        F.when(k % 2 == 0, F.array(F.concat(F.lit("(512) 555-"), _lpad4(k))))
         .otherwise(F.array().cast("array<string>")).alias("phones"),
        F.when(k % 5 == 0, F.array(F.concat(F.lit("https://linkedin.com/company/c"), k.cast("string"))))
         .otherwise(F.array().cast("array<string>")).alias("socials"),
        F.when(k % 7 == 1, F.concat(website, F.lit("/contact"))).alias("contact_url"),
        F.when(k % 7 == 0, F.array(F.struct(F.concat(F.lit("Owner "), k.cast("string")).alias("name"),
                                            F.lit("CEO").alias("role"))))
         .otherwise(F.array().cast("array<struct<name:string,role:string>>")).alias("people")))
    issues = F.when(k % 2 == 0, F.array(F.lit("Missing meta description"))) \
              .otherwise(F.array(F.lit("Site not served over HTTPS"), F.lit("No favicon detected")))
    seo = F.when(k % 13 != 0, _seo_struct(k, F.col("c_name"), website, k % 101, issues))
    created = (F.when(k % 50 == 0, F.lit(NOW_EPOCH) - (k % 9) * 86400 - (k % 3600))
               .otherwise(F.coalesce(_epoch(F.col("dmin")), F.lit(FALLBACK_EPOCH)) + k % 86400))
    updated = F.coalesce(_epoch(F.col("dmax")), F.lit(FALLBACK_EPOCH)) + k % 86400
    statuses = F.array(*[F.lit(s) for s in K.LEAD_STATUSES])
    t = j.select(
        k.cast("long").alias("id"), name.alias("name"), domain.alias("domain"), website.alias("website"),
        F.when(k % 4 != 0, F.concat(F.lit("Customer of nation "), F.col("c_nationkey").cast("string"))).alias("description"),
        F.lower("c_mktsegment").alias("query"), chans.alias("channels"), outreach.alias("outreach"), seo.alias("seo"),
        (F.floor(F.abs("c_acctbal")) % 101).cast("int").alias("score"),
        F.array(F.concat(F.lit("seed "), k.cast("string"))).alias("score_reasons"),
        F.element_at(statuses, (k % 6 + 1).cast("int")).alias("status"),
        F.when(k % 3 == 1, F.concat(F.lit("note "), k.cast("string"))).alias("notes"),
        (k % 4).cast("long").alias("run_id"),
        F.timestamp_seconds(created).alias("created_at"), F.timestamp_seconds(updated).alias("updated_at"))
    t = t.withColumn("opportunity_score", F.coalesce(F.col("seo.opportunity_score"), F.lit(0))) \
         .withColumn("issues_count", F.coalesce(F.size("seo.issues"), F.lit(0))) \
         .withColumn("has_email", F.coalesce(F.size("outreach.emails") > 0, F.lit(False)))
    return t.select(*S.STORED_LEAD.fieldNames())


def new_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_new_leads``: a run's leads; half of them hit stored domains with
    lower, equal and higher scores, null or present audit/outreach."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name", "c_nationkey", "c_acctbal")
    k = F.col("k")
    c = c.where((k % 2 == 0) | (k % 7 == 3))
    upd = k % 2 == 0
    domain = F.when(upd, lead_domain(k)).otherwise(F.concat(F.lit("new"), k.cast("string"), F.lit(".example.org")))
    website = F.concat(F.lit("https://"), domain)
    old = (F.floor(F.abs("c_acctbal")) % 101)
    score = F.greatest(F.lit(0), old + (k % 3 - 1) * 5).cast("int")
    outreach = F.when(k % 5 != 0, F.struct(
        F.array(F.concat(F.lit(" info@c"), k.cast("string"), F.lit(".example.com ")),
                F.concat(F.lit("sales@c"), k.cast("string"), F.lit(".example.com"))).alias("emails"),
        F.array(F.concat(F.lit("(512) 555-"), _lpad4(k))).alias("phones"),
        F.array().cast("array<string>").alias("socials"),
        F.concat(F.lit("https://x"), k.cast("string"), F.lit("/contact")).alias("contact_url"),
        F.array(F.struct(F.concat(F.lit("Owner "), k.cast("string")).alias("name"), F.lit("CTO").alias("role")),
                F.struct(F.concat(F.lit("Staff "), k.cast("string")).alias("name"),
                         F.lit(None).cast("string").alias("role"))).alias("people")))
    seo = F.when(k % 4 != 2, _seo_struct(k, F.col("c_name"), website, (k * 7) % 101,
                                         F.array(F.lit("Missing <title> tag"))))
    return c.select(
        F.concat(F.lit("New "), F.col("c_name")).alias("name"), website.alias("website"), domain.alias("domain"),
        F.when(k % 8 != 0, F.concat(F.lit("fresh "), k.cast("string"))).alias("description"),
        F.concat(F.lit("q"), F.col("c_nationkey").cast("string")).alias("query"),
        F.when(k % 3 != 0, F.array(F.lit("web"), F.lit("g2"))).alias("channels"),
        outreach.alias("outreach"), seo.alias("seo"), score.alias("score"),
        F.array(F.concat(F.lit("new "), k.cast("string"))).alias("score_reasons"))


def patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_patches``: status/notes patches incl. unknown ids, duplicates, an
    invalid status and empty patches."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    m = k % 10
    statuses = F.array(*[F.lit(s) for s in K.LEAD_STATUSES])
    one = F.struct(
        F.when(m == 3, k + 1000000).otherwise(k).cast("long").alias("id"),
        (F.when(m == 0, F.element_at(statuses, ((F.floor(k / 10) % 6) + 1).cast("int")))
          .when(m == 2, F.lit("bogus")).when(m == 3, F.lit("won")).when(m == 4, F.lit("qualified"))).alias("status"),
        F.when(m == 1, F.lit("")).alias("notes"), (m == 1).alias("set_notes"), (k * 2).alias("patch_ord"))
    two = F.struct(k.cast("long").alias("id"), F.lit("lost").alias("status"), F.lit(None).cast("string").alias("notes"),
                   F.lit(False).alias("set_notes"), (k * 2 + 1).alias("patch_ord"))
    rows = F.when(m == 4, F.array(one, two)).when(m <= 5, F.array(one)).otherwise(F.array().cast(
        "array<struct<id:bigint,status:string,notes:string,set_notes:boolean,patch_ord:bigint>>"))
    return c.select(F.explode(rows).alias("p")).select("p.*")


def delete_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_delete_ids``: ids to delete, with duplicates, unknown and non-integer ids."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    k = F.col("k")
    m = k % 10
    ids = (F.when(m == 7, F.array(k.cast("double"), k.cast("double")))
           .when(m == 8, F.array((k + 1000000).cast("double")))
           .when(m == 9, F.array(k.cast("double") + 0.5))
           .otherwise(F.array().cast("array<double>")))
    return c.select(F.explode(ids).alias("id"))


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_searches``: the saved searches behind ``fx_specs``."""
    from leadlake.plans.planning import normalize_specs
    s = normalize_specs(specs(spark, sf_dir), mode="saved")
    o = F.col("spec_ord")
    return s.select((o + 1).cast("long").alias("id"), "niche", "location", "lim", "channels",
                    F.when(o % 3 != 0, F.concat(F.lit("label "), o.cast("string"))).alias("label"),
                    (o % 4 != 3).alias("active"),
                    F.timestamp_seconds(F.lit(FALLBACK_EPOCH) + (o % 5) * 3600).alias("created_at"))


def new_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_new_searches``: re-saved keys (update) and new niches (insert)."""
    from leadlake.plans.planning import normalize_specs
    s = normalize_specs(specs(spark, sf_dir), mode="saved")
    o = F.col("spec_ord")
    upd = s.where(o % 2 == 0).select(
        "niche", "location", F.lit(7).alias("lim"),
        F.when(o % 4 == 0, F.array(F.lit("web"))).otherwise(F.array().cast("array<string>")).alias("channels"),
        F.lit("new").alias("label"), o.cast("long").alias("input_ord"))
    ins = s.where(o % 3 == 1).select(
        F.concat(F.col("niche"), F.lit(" pro")).alias("niche"), "location", F.lit(None).cast("int").alias("lim"),
        F.lit(None).cast("array<string>").alias("channels"), F.lit(None).cast("string").alias("label"),
        (o + 100).cast("long").alias("input_ord"))
    return upd.unionByName(ins)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fx_runs``: a run ledger, one run per nation."""
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("id"), "n_regionkey")
    i = F.col("id")
    err = i % 5 == 0
    return n.select(
        "id", F.timestamp_seconds(F.lit(FALLBACK_EPOCH) + i * 86400).alias("started_at"),
        F.timestamp_seconds(F.lit(FALLBACK_EPOCH) + i * 86400 + 3600).alias("finished_at"),
        F.when(err, F.lit("error")).otherwise(F.lit("done")).alias("status"),
        (F.col("n_regionkey") + 1).cast("int").alias("search_count"), (i * 3).cast("int").alias("lead_count"),
        (i % 2 == 0).alias("enrich"), F.when(err, F.concat(F.lit("boom "), i.cast("string"))).alias("error"))


# --------------------------------------------------------------------------- raw payloads

def serp_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search hits as provider payloads: one JSON object per (provider, query,
    result page of 20), results in rank order; every fifth description missing."""
    from leadlake.constants import PROVIDERS
    s = materialized(spark, sf_dir, "serp", all_serp)
    prov = F.element_at(F.array(*[F.lit(p) for p in PROVIDERS]), F.col("provider_ord") + 1)
    item = F.struct("rank", "url", "title",
                    F.when(F.col("rank") % 5 != 0, F.col("description")).alias("description"))
    g = s.groupBy("provider_ord", "query", F.floor((F.col("rank") - 1) / 20).alias("page")) \
         .agg(F.array_sort(F.collect_list(item)).alias("items"))
    return g.select(prov.alias("provider"), "query", F.col("page").cast("int").alias("page"),
                    F.transform("items", lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"),
                                                            x["description"].alias("description"))).alias("results"))


def places_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places payloads: one JSON object per (query, page) with up to 20 places."""
    p = materialized(spark, sf_dir, "places", places)
    g = p.groupBy("query", "page_no").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("items"))
    mx = p.groupBy("query").agg(F.max("page_no").alias("last"))
    g = g.join(mx, "query")
    return g.select("query", "page_no", F.transform("items", lambda x: x["p"]).alias("places"),
                    F.when(F.col("page_no") < F.col("last"),
                           F.concat(F.lit("tok"), (F.col("page_no") + 1).cast("string"))).alias("nextPageToken"))


def store_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lead store as JSON Lines documents of at most 500 leads each (the
    searches and runs ride in document 0), in the application's field names."""
    from leadlake.sources import schemas as S
    from leadlake.sources.sinks import _LEAD_JSON_NAMES, _json_type
    ts = {"created_at", "updated_at", "started_at", "finished_at"}
    l = materialized(spark, sf_dir, "leads", leads)
    item = F.struct(*[(F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c in ts else F.col(c).cast(_json_type(S.STORED_LEAD[c].dataType))).alias(n)
                      for n, c in _LEAD_JSON_NAMES])
    docs = l.groupBy(F.floor(F.col("id") / 500).alias("doc")).agg(F.collect_list(item).alias("leads"))
    s = materialized(spark, sf_dir, "searches", searches)
    r = materialized(spark, sf_dir, "runs", runs)
    s0 = s.select(F.struct(*[(F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c in ts else F.col(c)).alias(c)
                             for c in s.columns]).alias("x")).agg(F.collect_list("x").alias("searches"))
    r0 = r.select(F.struct(*[(F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c in ts else F.col(c)).alias(c)
                             for c in r.columns]).alias("x")).agg(F.collect_list("x").alias("runs"))
    extra = s0.withColumn("doc", F.lit(0).cast("long")).join(r0.withColumn("doc", F.lit(0).cast("long")), "doc")
    return docs.join(extra, "doc", "left").select("searches", "runs", "leads")


def drifting_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose ``props`` drift with ``event_id``: retyped, nested, unknown and null fields, lists, broken and missing payloads."""
    i, k = F.col("event_id"), F.regexp_extract("props", "[0-9]+", 0)
    of = lambda m, r: i % m == r
    text = (F.when(of(13, 1), F.concat(F.lit('{"k": "'), k, F.lit('"}')))
            .when(of(17, 2), F.concat(F.lit('{"k": {"v": '), k, F.lit('}, "src": "a"}')))
            .when(of(19, 3), F.concat(F.lit('{"k": '), k, F.lit(', "ref": "x'), _s(i), F.lit('", "w": '), k, F.lit(".5}")))
            .when(of(23, 4), F.concat(F.lit('{"k": '), k))
            .when(of(29, 5), F.lit(None).cast("string"))
            .when(of(31, 6), F.concat(F.lit("["), k, F.lit("]")))
            .when(of(37, 7), F.lit('{"k": null}'))
            .when(of(41, 8), F.concat(F.lit('{"k": '), k, F.lit(".25}")))
            .when(of(43, 9), F.concat(F.lit('{"items": [{"sku": "a", "n": 1}, {"sku": '), _s(i), F.lit(', "n": "2"}, 3]}')))
            .otherwise(F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", text.alias("props"))
