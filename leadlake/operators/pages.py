"""Page-level operators: signals, audit, contacts, scrape report (#51, #56, #57, flagship).

Every operator here is a single narrow projection over the page table: the
wide ``html`` column is read once, all signals are derived in one ``select``
directly on the scan, and ``html`` is dropped before anything downstream can
shuffle it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.functions import contacts as C
from leadlake.functions import html as H
from leadlake.functions.scoring import ScoreWeights, score_lead
from leadlake.functions.seo import AuditRules, audit_seo
from leadlake.functions.urls import parse_url_parts

DEFAULT_STATUS = 200


def with_status(pages: DataFrame) -> DataFrame:
    """Captured pages without a status column were successful fetches (200)."""
    if "status_code" in pages.columns:
        return pages
    return pages.withColumn("status_code", F.lit(DEFAULT_STATUS))


def with_final_url(pages: DataFrame) -> DataFrame:
    """Captures without a final URL were not redirected."""
    if "final_url" in pages.columns:
        return pages.withColumn("final_url", F.coalesce("final_url", "url"))
    return pages.withColumn("final_url", F.col("url"))


def page_signals(pages: DataFrame, *, favicon_source: str = "meta", h1_source: str = "markdown",
                 keep: list[str] | None = None) -> DataFrame:
    """Metadata struct parts, page text and links of each page, ``html`` dropped (#51).

    ``keep`` lists extra input columns to carry through (keys, ordinals)."""
    pages = with_final_url(with_status(pages))
    keep = keep if keep is not None else [c for c in pages.columns if c not in ("html", "url", "status_code", "final_url", "captured_at")]
    html = F.col("html")
    # the page's own links and the https rule go by the URL at which it was found
    base = pages.select(*keep, "url", "final_url", F.col("status_code").cast("int").alias("status_code"), "html",
                        parse_url_parts(F.col("final_url")).alias("_base"), H.meta_tags(html).alias("_metas"))
    metas = F.col("_metas")
    cols = [
        *[F.col(c) for c in keep],
        F.col("url"),
        F.col("status_code"),
        F.col("final_url"),
        H.extract_title(html).alias("title"),
        H.meta_content(metas, "description").alias("description"),
        H.meta_content(metas, "og:title").alias("og_title"),
        H.meta_content(metas, "og:description").alias("og_description"),
        H.meta_content(metas, "og:image").alias("og_image"),
        H.favicon(html if favicon_source == "link" else metas, favicon_source).alias("favicon"),
        H.html_to_text(html).alias("text"),
        H.extract_links(html, F.col("_base")).alias("links"),
    ]
    if h1_source == "html":
        cols.append(H.has_html_h1(html).alias("html_h1"))
    sig = base.select(*cols)
    # derived once from the text, referenced several times by the audit
    return sig.withColumn("words", H.word_count(F.col("text"), normalized=True)) \
              .withColumn("md_h1", H.has_markdown_h1(F.col("text")))


def audit_column(sig_prefix: str = "", requested_url: Column | None = None,
                 rules: AuditRules = AuditRules(), h1_source: str = "markdown") -> Column:
    """Audit struct over the columns produced by ``page_signals``."""
    c = (lambda n: F.col(sig_prefix + n))
    return audit_seo(final_url=c("final_url"), status_code=c("status_code"), title=c("title"),
                     og_title=c("og_title"), description=c("description"),
                     og_description=c("og_description"), og_image=c("og_image"),
                     favicon=c("favicon"), text=c("text"),
                     requested_url=requested_url if requested_url is not None else c("url"),
                     has_h1=c("html_h1") if h1_source == "html" else c("md_h1"), words=c("words"), rules=rules)


def audit_pages(pages: DataFrame, rules: AuditRules = AuditRules(), **opts) -> DataFrame:
    """Per page: the SEO audit struct (#59 over a page table)."""
    sig = page_signals(pages, **opts)
    return sig.select("page_id", "url", audit_column(rules=rules, h1_source=opts.get("h1_source", "markdown")).alias("seo"))


def page_contacts(sig: DataFrame, social_match: str = "substring") -> DataFrame:
    """Adds emails, phones, socials (home page contacts) to a signals frame."""
    return (sig.withColumn("emails", C.extract_emails(F.col("text")))
               .withColumn("phones", C.extract_phones(F.col("text")))
               .withColumn("socials", C.extract_socials(F.col("links.external"), social_match)))


def score_pages(pages: DataFrame, rules: AuditRules = AuditRules(), weights: ScoreWeights = ScoreWeights(),
                **opts) -> DataFrame:
    """Flagship: every page audited, contacts extracted, scored.

    One scan and narrow projections only (no shuffle); callers that need the
    rows best-first sort the (narrow) result."""
    sig = page_contacts(page_signals(pages, **opts))
    outreach = C.outreach_struct(F.col("emails"), F.col("phones"), F.col("socials"), F.lit(None))
    scored = (sig.withColumn("seo", audit_column(rules=rules, h1_source=opts.get("h1_source", "markdown")))
                 .withColumn("outreach", outreach)
                 .withColumn("_s", score_lead(F.col("seo"), F.col("outreach"), weights)))
    return scored.select(
        "page_id", "url", "seo", "outreach",
        F.col("_s.score").alias("score"), F.col("_s.reasons").alias("score_reasons"),
    )


def successful_pages(pages: DataFrame) -> DataFrame:
    """Pages with a 2xx status; others carry ``error = 'HTTP {status}'`` (#57).

    Returns all pages with ``success`` and ``error`` so a caller can count both."""
    pages = with_status(pages)
    st = F.col("status_code")
    ok = F.coalesce((st >= 200) & (st <= 299), F.lit(False))
    err = F.when(~ok, F.when(st.isNull(), F.lit("fetch failed"))
                 .otherwise(F.concat(F.lit("HTTP "), st.cast("string"))))
    return pages.withColumn("success", ok).withColumn("error", err)


def scrape_report(pages: DataFrame, social_match: str = "substring", **opts) -> DataFrame:
    """Single-page scrape view over a page table (#56): status, link counts,
    contacts, presence of each SEO signal and text length."""
    sig = page_contacts(page_signals(pages, **opts), social_match)
    return sig.select(
        "page_id", "url", "status_code",
        F.size("links.internal").alias("internal_links"),
        F.size("links.external").alias("external_links"),
        "emails", "phones", "socials",
        "title", "description", "og_title",
        F.col("og_image").isNotNull().alias("has_og_image"),
        F.col("favicon").isNotNull().alias("has_favicon"),
        F.col("md_h1").alias("has_h1"),
        F.length("text").alias("text_length"),
    )
