"""Lead-table queries: filters, sorts, statistics, export view (#77-#92).

All filters are plain predicates, so Catalyst merges them and pushes the
simple ones (status, score, has_email) into the Parquet scan of the lead table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlake import constants as K


@dataclass
class LeadFilter:
    status: str | None = None
    min_score: float | None = None
    has_email: bool = False
    q: str | None = None
    channel: str | None = None
    period: str | None = None
    date_from: str | None = None
    date_to: str | None = None
    sort: str = "score"


def filter_status(status: str) -> Column:
    """#77."""
    return F.col("status") == status


def filter_min_score(n: float) -> Column:
    """#78."""
    return F.col("score") >= n


def filter_has_email() -> Column:
    """#79."""
    return F.coalesce(F.col("has_email"), F.lit(False))


def filter_text(q: str) -> Column:
    """#80: case-insensitive substring of name or domain."""
    ql = q.lower()
    return F.lower("name").contains(ql) | F.lower("domain").contains(ql)


def filter_channel(channel: str) -> Column:
    """#81."""
    return F.array_contains(F.col("channels"), channel)


def filter_period(period: str, now: str, tz: str = "UTC") -> Column:
    """#82 (Q13): ``today``/``yesterday`` compare calendar dates in ``tz``;
    ``week`` = at most 7x24 h before now (future rows pass); ``month``/``year``
    compare UTC calendar fields."""
    c, n = F.col("created_at"), F.to_timestamp(F.lit(now))
    local = lambda t: F.to_date(F.from_utc_timestamp(t, tz))
    if period == "today":
        return local(c) == local(n)
    if period == "yesterday":
        return local(c) == F.date_sub(local(n), 1)
    if period == "week":
        return (F.unix_micros(n) - F.unix_micros(c)) <= 7 * 86400 * 1_000_000
    if period == "month":
        return (F.year(c) == F.year(n)) & (F.month(c) == F.month(n))
    if period == "year":
        return F.year(c) == F.year(n)
    raise ValueError(f"unknown period {period}")


def filter_date_range(date_from: str | None, date_to: str | None) -> Column:
    """#83: inclusive by calendar day (UTC) of created_at."""
    d = F.date_format("created_at", "yyyy-MM-dd")
    cond = F.lit(True)
    if date_from:
        cond = cond & (d >= date_from)
    if date_to:
        cond = cond & (d <= date_to)
    return cond


def lead_predicate(f: LeadFilter, now: str | None = None, tz: str = "UTC") -> Column:
    cond = F.lit(True)
    if f.status:
        cond = cond & filter_status(f.status)
    if f.min_score is not None:
        cond = cond & filter_min_score(f.min_score)
    if f.has_email:
        cond = cond & filter_has_email()
    if f.q:
        cond = cond & filter_text(f.q)
    if f.channel:
        cond = cond & filter_channel(f.channel)
    if f.period:
        cond = cond & filter_period(f.period, now, tz)
    if f.date_from or f.date_to:
        cond = cond & filter_date_range(f.date_from, f.date_to)
    return cond


def sort_columns(sort: str) -> list[Column]:
    """Sort keys; ties keep insertion order (``id``)."""
    if sort == "opportunity":
        return [F.col("opportunity_score").desc(), F.col("id")]
    if sort == "recent":
        return [F.col("updated_at").desc(), F.col("id")]
    if sort == "name":
        return [F.collate(F.col("name"), "UNICODE").asc(), F.col("id")]
    return [F.col("score").desc(), F.col("id")]


def list_leads(store: DataFrame, f: LeadFilter = LeadFilter(), now: str | None = None, tz: str = "UTC") -> DataFrame:
    """#84: all filters ANDed, then one of the four sorts."""
    return store.where(lead_predicate(f, now, tz)).orderBy(*sort_columns(f.sort))


def top_leads(store: DataFrame, n: int = 6) -> DataFrame:
    """#85: best by score (a top-k report: ``TakeOrderedAndProject``)."""
    return store.orderBy(F.col("score").desc(), F.col("id")).limit(n)


def lead_stats(store: DataFrame, searches: DataFrame, runs: DataFrame) -> DataFrame:
    """#86: one row: total, rounded average score (0 if empty), hot (>=70), with
    email, active searches, runs, start of the newest run. The three tables are
    tagged and unioned, then reduced by a single global aggregate (partial
    aggregation per partition, one tiny final merge) -- no join."""
    n = F.lit(None)
    u = (store.select(F.lit("lead").alias("src"), F.col("score").cast("double").alias("score"),
                      F.coalesce(F.col("has_email"), F.lit(False)).alias("has_email"),
                      n.cast("boolean").alias("active"), n.cast("long").alias("run_id"),
                      n.cast("timestamp").alias("started_at"))
         .unionByName(searches.select(F.lit("search").alias("src"), n.cast("double").alias("score"),
                                      F.lit(False).alias("has_email"), F.col("active"),
                                      n.cast("long").alias("run_id"), n.cast("timestamp").alias("started_at")))
         .unionByName(runs.select(F.lit("run").alias("src"), n.cast("double").alias("score"),
                                  F.lit(False).alias("has_email"), n.cast("boolean").alias("active"),
                                  F.col("id").cast("long").alias("run_id"), F.col("started_at"))))
    lead = F.col("src") == "lead"
    return u.agg(
        F.count_if(lead).alias("total_leads"),
        F.coalesce(F.round(F.avg("score")), F.lit(0)).cast("long").alias("avg_score"),
        F.count_if(lead & (F.col("score") >= K.HOT_SCORE)).alias("hot_leads"),
        F.count_if(lead & F.col("has_email")).alias("with_email"),
        F.count_if(F.coalesce(F.col("active"), F.lit(False))).alias("active_searches"),
        F.count_if(F.col("src") == "run").alias("total_runs"),
        F.max_by("started_at", "run_id").alias("last_run_at"))


def status_counts(store: DataFrame) -> DataFrame:
    """#87: leads per status with the share of all leads."""
    c = store.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy(F.lit(1))))


def filtered_summary(df: DataFrame) -> DataFrame:
    """#88: total, with email, % with email (rounded), hot, rounded average."""
    a = df.agg(F.count(F.lit(1)).alias("total"),
               F.count_if(F.coalesce(F.col("has_email"), F.lit(False))).alias("with_email"),
               F.count_if(F.col("score") >= K.HOT_SCORE).alias("hot"),
               F.coalesce(F.round(F.avg("score")), F.lit(0)).cast("long").alias("avg"))
    pct = F.when(F.col("total") > 0, F.round(F.col("with_email") / F.col("total") * 100)).cast("long")
    return a.withColumn("pct_with_email", pct)


def export_view(df: DataFrame) -> DataFrame:
    """#89: the 15 export columns; arrays joined with ``"; "``, people as
    ``Name (Role)``, nulls as empty strings (score/opportunity as numbers)."""
    o = F.col("outreach")
    j = lambda c: F.coalesce(F.array_join(c, "; "), F.lit(""))
    people = F.transform(o["people"], lambda p: F.when(F.coalesce(p["role"], F.lit("")) != "",
                                                      F.concat(p["name"], F.lit(" ("), p["role"], F.lit(")")))
                         .otherwise(p["name"]))
    ts = F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss")
    return df.select(
        F.col("name").alias("business"), F.col("website").alias("website"), F.col("score").cast("string").alias("score"),
        F.col("opportunity_score").cast("string").alias("seo_opportunity"), F.col("status").alias("status"),
        j(F.col("channels")).alias("channels"), j(o["emails"]).alias("emails"), j(o["phones"]).alias("phones"),
        j(o["socials"]).alias("socials"), F.coalesce(o["contact_url"], F.lit("")).alias("contact_page"),
        j(people).alias("people"), j(F.col("seo.issues")).alias("seo_issues"),
        F.coalesce(F.col("query"), F.lit("")).alias("search"), F.coalesce(F.col("notes"), F.lit("")).alias("notes"),
        ts.alias("updated_at"))


def primary_contact(df: DataFrame) -> DataFrame:
    """#90: first email and first phone per lead."""
    return df.select("id", F.get(F.col("outreach.emails"), 0).alias("email"),
                     F.get(F.col("outreach.phones"), 0).alias("phone"))


def encode_uri_component(c: Column) -> Column:
    """``encodeURIComponent``: ``url_encode`` (form encoding) adjusted to RFC 3986:
    ``+`` -> ``%20`` and the marks ``! ' ( ) *`` left unescaped, ``~`` kept."""
    e = F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    for enc, ch in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*"), ("%7E", "~")):
        e = F.replace(e, F.lit(enc), F.lit(ch))
    return e


def research_links(df: DataFrame) -> DataFrame:
    """#91: per lead and channel, the channel's search URL for the lead's query;
    plus one name+domain lookup link per lead."""
    from leadlake.sources.dims import channel_links
    links = channel_links(df.sparkSession)
    per = (df.where(F.col("query").isNotNull())
             .select("id", "query", F.posexplode("channels").alias("pos", "channel"))
             .join(F.broadcast(links), "channel")
             .select("id", F.col("pos").cast("long").alias("pos"), "channel",
                     F.concat(F.col("url_prefix"), encode_uri_component(F.col("query"))).alias("link")))
    look = df.select("id", F.lit(-1).cast("long").alias("pos"), F.lit("lookup").alias("channel"),
                     F.concat(F.lit(K.LOOKUP_URL),
                              encode_uri_component(F.concat(F.col("name"), F.lit(" "), F.col("domain")))).alias("link"))
    return per.unionByName(look)


def audit_checklist(df: DataFrame) -> DataFrame:
    """#92: seven pass/fail checks per audited lead, in long form."""
    s = F.col("seo")
    tl = F.when(F.coalesce(s["title_length"], F.lit(0)) != 0,
                F.concat(F.lit(" ("), s["title_length"].cast("string"), F.lit(" chars)"))).otherwise(F.lit(""))
    dl = F.when(F.coalesce(s["description_length"], F.lit(0)) != 0,
                F.concat(F.lit(" ("), s["description_length"].cast("string"), F.lit(")"))).otherwise(F.lit(""))
    items = [
        ("HTTPS", F.lit("HTTPS"), F.coalesce(s["https_ok"], F.lit(False))),
        ("title", F.concat(F.lit("Title"), tl), s["title"].isNotNull()),
        ("description", F.concat(F.lit("Meta description"), dl), s["description"].isNotNull()),
        ("h1", F.lit("H1 heading"), F.coalesce(s["has_h1"], F.lit(False))),
        ("og_title", F.lit("Open Graph title"), F.coalesce(s["has_og_title"], F.lit(False))),
        ("og_image", F.lit("Open Graph image"), F.coalesce(s["has_og_image"], F.lit(False))),
        ("favicon", F.lit("Favicon"), F.coalesce(s["has_favicon"], F.lit(False))),
    ]
    checks = F.array(*[F.struct(F.lit(i + 1).alias("pos"), lab.alias("label"), ok.alias("ok"))
                       for i, (_, lab, ok) in enumerate(items)])
    return df.where(s.isNotNull()).select("id", F.inline(checks))
