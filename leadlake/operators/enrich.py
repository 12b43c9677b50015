"""Enrichment and lead building (#58, #61-#63, #76).

The captured-page table is semi-joined to the URLs the candidates need, once for the
home pages and once for the contact pages of those without an email; every signal is
derived in one projection, and only narrow results (audit struct, contacts, brand name) are
joined back to the candidates. Other pages are left out in the scan (``prune``), so their
HTML crosses no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlake.functions import contacts as C
from leadlake.functions.names import brand_name
from leadlake.functions.regex import clean_distinct
from leadlake.functions.scoring import ScoreWeights, score_lead
from leadlake.functions.seo import AuditRules
from leadlake.functions.urls import contact_url, normalize_url
from leadlake.operators import discovery as D
from leadlake.operators.pages import audit_column, page_contacts, page_signals, with_status
from leadlake.operators.prune import prune


def with_url_key(pages: DataFrame) -> DataFrame:
    """Captures with ``url_key``, the normal form of ``url``. A table that has the column keeps it,
    so captures that are enriched often can be stored with it."""
    return pages if "url_key" in pages.columns else pages.withColumn("url_key", normalize_url(F.col("url")))


def _wanted(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """The captures of the URLs, compared in normal form, with that form as ``url_key``."""
    need = urls.select(normalize_url(F.col("url")).alias("_u")).where(F.col("_u").isNotNull()).distinct().checkpoint()
    p = prune(with_url_key(with_status(pages)), ["url_key"], need)
    return p.join(need, F.col("url_key") == F.col("_u"), "left_semi")


def _one_capture(rows: DataFrame, order: list[str]) -> DataFrame:
    """One row per ``url_key``: a successful capture before others, then the last by ``order``."""
    rest = [c for c in rows.columns if c != "url_key"]
    latest = F.max_by(F.struct(*rest), F.struct("success", *order, F.hash("brand", "emails", "phones", "socials")))
    return rows.groupBy("url_key").agg(latest.alias("_r")).select("url_key", *[F.col(f"_r.{c}").alias(c) for c in rest])


def enriched_pages(pages: DataFrame, urls: DataFrame, rules: AuditRules = AuditRules(),
                   social_match: str = "substring") -> DataFrame:
    """Per wanted URL (``url_key``): success flag, audit, contacts, brand of one capture, the
    last by ``captured_at`` or else ``page_id`` where the table has them."""
    p = _wanted(pages, urls)
    order = [c for c in ("captured_at", "page_id") if c in p.columns]
    sig = page_contacts(page_signals(p, keep=["url_key", *order]), social_match)
    st = F.col("status_code")
    rows = sig.select(
        "url_key", *order, F.coalesce((st >= 200) & (st <= 299), F.lit(False)).alias("success"),
        audit_column(rules=rules).alias("seo"), "emails", "phones", "socials",
        brand_name(F.col("og_title"), F.col("title")).alias("brand"))
    return _one_capture(rows, order).drop(*order)


def enrich(cands: DataFrame, pages: DataFrame, rules: AuditRules = AuditRules(),
           social_match: str = "substring") -> DataFrame:
    """#58: home page by website; audit + contacts; only when the home page has no
    email, the ``/contact`` page: emails replaced, phones and socials unioned,
    ``contact_url`` set when emails or phones exist. A missing or failed home page
    gives a null enrichment (the candidate is kept).

    URLs are compared in normal form, and of several captures of a URL one counts, so
    candidates are never multiplied. Contact pages are wanted only for the candidates
    that need one; the others don't take part in that join."""
    c = cands.withColumn("_cu", contact_url(F.col("website"))).withColumn("_hk", normalize_url(F.col("website")))
    home = enriched_pages(pages, c.select(F.col("website").alias("url")), rules, social_match)
    home = home.select(*[F.col(x).alias("h_" + x) for x in home.columns])
    j = c.join(home, F.col("_hk") == F.col("h_url_key"), "left").withColumn("_ok", F.coalesce("h_success", F.lit(False)))
    j = j.checkpoint()  # read three times below
    need = F.col("_ok") & (F.size("h_emails") == 0)
    asking = j.where(need).withColumn("_ck", normalize_url(F.col("_cu")))
    contact = enriched_pages(pages, asking.select(F.col("_cu").alias("url")), rules, social_match).where("success")
    contact = contact.select(*[F.col(x).alias("x_" + x) for x in ("url_key", "emails", "phones", "socials")])
    asked = asking.join(contact, F.col("_ck") == F.col("x_url_key"), "left").drop("_ck")
    others = j.where(~need)
    for f in contact.schema.fields:
        others = others.withColumn(f.name, F.lit(None).cast(f.dataType))
    j = asked.unionByName(others)
    got = F.col("x_url_key").isNotNull()
    emails = F.when(got, F.col("x_emails")).otherwise(F.col("h_emails"))
    phones = F.when(got, clean_distinct(F.concat("h_phones", "x_phones"))).otherwise(F.col("h_phones"))
    socials = F.when(got, clean_distinct(F.concat("h_socials", "x_socials"))).otherwise(F.col("h_socials"))
    cu = F.when(got & ((F.size(emails) > 0) | (F.size(phones) > 0)), F.col("_cu"))
    outreach = F.when(F.col("_ok"), C.outreach_struct(emails, phones, socials, cu))
    return j.select(*[x for x in cands.columns],
                    outreach.alias("outreach"), F.when(F.col("_ok"), F.col("h_seo")).alias("seo"),
                    F.when(F.col("_ok"), F.col("h_brand")).alias("brand"))


def build_leads(cands: DataFrame, pages: DataFrame | None, enrich_pages: bool = True,
                rules: AuditRules = AuditRules(), weights: ScoreWeights = ScoreWeights()) -> DataFrame:
    """#62: enrichment -> fold the discovery phone (#61) -> score (#60). Name = the
    site's brand name, else the candidate name. ``enrich_pages=False`` skips pages."""
    if enrich_pages and pages is not None:
        e = enrich(cands, pages, rules)
    else:
        from leadlake.sources import schemas as S
        e = cands.select(*cands.columns, F.lit(None).cast(S.OUTREACH).alias("outreach"),
                         F.lit(None).cast(S.SEO).alias("seo"), F.lit(None).cast("string").alias("brand"))
    e = e.withColumn("outreach", C.fold_phone(F.col("outreach"), F.col("phone")))
    s = score_lead(F.col("seo"), F.col("outreach"), weights)
    keep = [x for x in cands.columns if x not in ("name",)]
    return e.select(*keep, F.coalesce(F.col("brand"), F.col("name")).alias("name"), "outreach", "seo",
                    s["score"].alias("score"), s["reasons"].alias("score_reasons"))


def run_search(specs: DataFrame, serp: DataFrame, places: DataFrame | None, pages: DataFrame | None,
               known: DataFrame | None = None, enrich_pages: bool = True, cross_spec: bool = False) -> DataFrame:
    """#63 (and #76 with ``cross_spec=True``): plan -> discover -> known-domain exclusion
    -> merge -> cap -> leads. Rows carry ``spec_ord``, ``cand_rank`` and ``score``; sort by
    spec, score descending and rank for the application's list.

    ``cross_spec``: specs run one after another, as a saved run does: a domain that an earlier
    spec *kept* is known to later ones, which fill up with their next candidates."""
    from leadlake.plans.planning import plan_queries
    planned = plan_queries(specs)
    cands = D.discover_channels(planned, serp, places, known, limit_web=not cross_spec)
    if known is not None:
        cands = D.exclude_known(cands, known)
    # the capped list feeds enrichment twice (URL semi-join and main join): checkpoint it so
    # discovery runs once
    if cross_spec:
        capped = D.run_across_specs(cands.checkpoint(), specs).checkpoint()
    else:
        capped = D.cap_candidates(D.merge_candidates(cands), specs).checkpoint()
    return build_leads(capped, pages, enrich_pages)


@dataclass
class SavedRun:
    """What a saved run leaves: the new lead table, the ledger, the counters and a summary."""

    leads: DataFrame
    runs: DataFrame
    counters: dict[str, int]
    run_id: int
    search_count: int
    lead_count: int
    errors: list[dict[str, str]]


def saved_run(searches: DataFrame, runs: DataFrame, store: DataFrame, serp: DataFrame, places: DataFrame | None, pages: DataFrame | None,
              now: str, finished: str | None = None, counters: dict[str, int] | None = None, enrich_pages: bool = True) -> SavedRun:
    """#76, the whole of it: open a ledger row, run all active searches one after another (``run_search`` with
    ``cross_spec`` over the stored domains), upsert all their leads at the end, close the row.

    A search that can't be a spec (blank niche) is an entry of ``errors`` and the others go on. An error of the
    run itself closes the row as ``error``, changes no lead and is told in ``errors`` as that of all
    searches. Without active searches the row is closed at once. ``counters`` are the stored ids (``store.counters``)."""
    from leadlake.operators import store as ST
    from leadlake.plans.planning import normalize_specs

    active = ST.list_searches(searches, active_only=True).select("id", "niche", "location", "lim", "channels", "created_at")
    order = F.row_number().over(W.orderBy(F.col("created_at").desc(), F.col("id"))) - 1  # one row per saved search
    specs = active.select(order.cast("int").alias("spec_ord"), "id", "niche", "location", "lim", "channels").checkpoint()
    count = specs.count()
    ledger, run_id = ST.start_run(runs, count, enrich_pages, now, (counters or {}).get("next_run_id"))
    good = normalize_specs(specs.drop("id"), mode="saved")
    bad = specs.join(good.select("spec_ord"), "spec_ord", "left_anti").orderBy("spec_ord")
    errors = [{"search": str(r.id), "error": "no niche"} for r in bad.select("id").toLocalIterator()]
    leads, found, failed = store, 0, None
    if count > len(errors):
        try:
            new = run_search(good, serp, places, pages, store.select("domain"), enrich_pages, cross_spec=True).checkpoint()
            found = new.count()
            new = new.withColumn("score_ord", -F.col("score"))  # a search returns its leads by score
            leads = ST.upsert_leads(store, new, run_id, now, ["spec_ord", "score_ord", "cand_rank"], (counters or {}).get("next_lead_id")).checkpoint()
        except Exception as e:  # noqa: BLE001 - the ledger must say how the run ended
            failed = str(e).splitlines()[0][:500]
            errors.append({"search": "*", "error": failed})
            leads, found = store, 0
    ledger = ST.finish_run(ledger, run_id, found, finished or now, failed)
    return SavedRun(leads, ledger, ST.counters(searches, ledger, leads, counters), run_id, count, found, errors)
