"""Lead-table, search and run-ledger maintenance (#65-#75).

Tables are versioned folders, never rewritten in place: every maintenance
operator returns a new DataFrame that ``leadlake.sources.sinks.save_table``
writes to a new version directory. Upserts are one full-outer equi-join on the
key (domain / niche+location), so each side is shuffled once by the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlake import constants as K
from leadlake.functions import names as N
from leadlake.functions.regex import WS, clean_distinct
from leadlake.sources import schemas as S



def _empty() -> Column:
    return F.array().cast("array<string>")


def merge_outreach(prev: Column, nxt: Column) -> Column:
    """#65: null-safe union. emails/phones/socials: trimmed, non-empty, distinct in
    order; contact_url: previous first; people keyed by name, position of the
    first occurrence with the value of the last."""
    def u(f):
        return clean_distinct(F.concat(F.coalesce(prev[f], _empty()), F.coalesce(nxt[f], _empty())))
    people = F.concat(F.coalesce(prev["people"], F.array().cast("array<struct<name:string,role:string>>")),
                      F.coalesce(nxt["people"], F.array().cast("array<struct<name:string,role:string>>")))
    named = F.filter(people, lambda p: F.coalesce(p["name"], F.lit("")) != "")
    names = F.array_distinct(F.transform(named, lambda p: p["name"]))
    merged_people = F.transform(names, lambda n: F.element_at(F.filter(named, lambda p: p["name"] == n), -1))
    both = F.struct(u("emails").alias("emails"), u("phones").alias("phones"), u("socials").alias("socials"),
                    F.coalesce(prev["contact_url"], nxt["contact_url"]).alias("contact_url"),
                    merged_people.alias("people"))
    return F.when(prev.isNull(), nxt).when(nxt.isNull(), prev).otherwise(both)


def _ts(now: str) -> Column:
    return F.to_timestamp(F.lit(now))


def sequential_ids(df: DataFrame, order: list[str | Column], last_id: int) -> DataFrame:
    """``df`` with ``new_id`` = last_id + 1, + 2, ... in the given order.

    The rows are range-partitioned by the order and written to a checkpoint, so that
    their partitions stay as they are; a row's place is its place in its partition plus
    the rows of the partitions before, of which there is one count per partition."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    r = (df.repartitionByRange(*cols).sortWithinPartitions(*cols)
           .withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()).checkpoint())
    sizes = r.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", "_from", before.alias("_before"))
    return (r.join(starts, "_part")
             .withColumn("new_id", (F.lit(last_id) + F.col("_before") + F.col("_at") - F.col("_from") + 1).cast("long"))
             .drop("_part", "_at", "_from", "_before"))


def fold_leads(leads: DataFrame, order_cols: list[str]) -> DataFrame:
    """One row per domain: its rows folded one after another in the given order, as the
    upsert folds a lead into a stored one. name, website, query, channels: the last;
    description and audit: the last that is not null; outreach merged; the highest score
    with the reasons of the last row that has it. ``first_seen`` is the order of the first."""
    o = F.struct(*[F.col(c) for c in order_cols])
    x = leads.withColumn("_o", o)
    last = ["name", "website", "query", "channels"]
    g = x.groupBy("domain").agg(
        F.max_by(F.struct(*last), "_o").alias("_last"),
        F.max_by("description", F.when(F.col("description").isNotNull(), F.col("_o"))).alias("description"),
        F.max_by("seo", F.when(F.col("seo").isNotNull(), F.col("_o"))).alias("seo"),
        F.max("score").alias("score"), F.max_by("score_reasons", F.struct("score", "_o")).alias("score_reasons"),
        F.array_sort(F.collect_list(F.when(F.col("outreach").isNotNull(), F.struct("_o", "outreach")))).alias("_out"),
        F.min("_o").alias("first_seen"))
    outs = F.transform("_out", lambda s: s["outreach"])
    merged = F.when(F.size(outs) > 0, F.aggregate(
        F.slice(outs, 2, F.greatest(F.size(outs) - 1, F.lit(0))), F.get(outs, 0), lambda a, b: merge_outreach(a, b)))
    return g.select("domain", *[F.col(f"_last.{c}").alias(c) for c in last], "description", merged.alias("outreach"),
                    "seo", "score", "score_reasons", "first_seen")


def upsert_leads(store: DataFrame, leads: DataFrame, run_id: int, now: str,
                 order_cols: list[str] | None = None, next_id: int | None = None) -> DataFrame:
    """#66: match on domain. Update: name, website, query, channels overwritten;
    description new-else-old; outreach merged; audit new-else-old; score = max;
    reasons from the winner (tie -> new); derived opportunity/issue count/has_email;
    run id and updated_at set; id, status, notes, created_at kept. Insert: next id
    in input order, status ``new``, notes null.

    A domain that ``leads`` has several times is folded first (``fold_leads``), in the
    order of ``order_cols``; by that order new domains get their ids too. Default: the
    column ``input_ord`` if there is one, else the domain and the row's values. ``next_id``
    is the stored counter of ids; without it ids go on from the highest id in the table,
    so that the id of a deleted last lead would be given again.

    One full-outer join on domain and one projection; ids are numbered without a window
    over all new leads (``sequential_ids``)."""
    ts = _ts(now)
    last_id = next_id - 1 if next_id is not None else store.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    order = order_cols or (["input_ord"] if "input_ord" in leads.columns else ["domain", "score", "name", "website", "query"])
    leads = fold_leads(leads, order)
    fresh = leads.join(store.select("domain"), "domain", "left_anti").select("domain", "first_seen")
    new_ids = sequential_ids(fresh, ["first_seen"], last_id).select(F.col("domain").alias("_nd"), F.col("new_id").alias("_nid"))
    o = store.alias("o")
    n = leads.alias("n")
    j = (o.join(n, F.col("o.domain") == F.col("n.domain"), "full_outer")
          .join(new_ids, F.col("n.domain") == F.col("_nd"), "left"))
    old, new = F.col("o.id").isNotNull(), F.col("n.domain").isNotNull()
    outreach = merge_outreach(F.col("o.outreach"), F.col("n.outreach"))
    seo = F.coalesce(F.col("n.seo"), F.col("o.seo"))
    score = F.greatest(F.col("n.score"), F.coalesce(F.col("o.score"), F.lit(0)))
    reasons = F.when(score == F.col("n.score"), F.col("n.score_reasons")) \
               .otherwise(F.coalesce(F.col("o.score_reasons"), F.col("n.score_reasons")))
    fresh_vals = {
        "name": F.col("n.name"), "website": F.col("n.website"),
        "description": F.coalesce(F.col("n.description"), F.col("o.description")),
        "query": F.col("n.query"), "channels": F.coalesce(F.col("n.channels"), _empty()),
        "outreach": outreach, "seo": seo, "score": score.cast("int"),
        "opportunity_score": F.coalesce(seo["opportunity_score"], F.lit(0)),
        "issues_count": F.coalesce(F.size(seo["issues"]), F.lit(0)),
        "has_email": F.coalesce(F.size(outreach["emails"]) > 0, F.lit(False)),
        "score_reasons": reasons, "run_id": F.lit(run_id).cast("long"), "updated_at": ts,
    }
    cols = []
    for c in S.STORED_LEAD.fieldNames():
        if c == "id":
            e = F.coalesce(F.col("o.id"), F.col("_nid"))
        elif c == "domain":
            e = F.coalesce(F.col("o.domain"), F.col("n.domain"))
        elif c == "status":
            e = F.when(old, F.col("o.status")).otherwise(F.lit("new"))
        elif c == "notes":
            e = F.col("o.notes")
        elif c == "created_at":
            e = F.when(old, F.col("o.created_at")).otherwise(ts)
        else:
            e = F.when(new, fresh_vals[c]).otherwise(F.col("o." + c))
        cols.append(e.alias(c))
    return j.select(*cols)


def counters(searches: DataFrame, runs: DataFrame, leads: DataFrame, stored: dict[str, int] | None = None) -> dict[str, int]:
    """The three id counters (``next_search_id``, ``next_run_id``, ``next_lead_id``) to be stored with the tables: the
    stored ones (``sinks.load_counters``), moved on past every id that the tables have."""
    tables = {"next_search_id": searches, "next_run_id": runs, "next_lead_id": leads}
    return {name: next_id(t, (stored or {}).get(name)) for name, t in tables.items()}


def known_domains(store: DataFrame) -> DataFrame:
    """#67: distinct stored domains."""
    return store.select("domain").distinct()


def patch_leads(store: DataFrame, patches: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """#68: ``patches(id, status, notes, set_notes, patch_ord)``. A patch with an
    invalid status is rejected whole (returned as the second frame); otherwise the
    status is set when given, notes when ``set_notes`` (empty string allowed), and
    ``updated_at`` bumped even for an empty patch. Patches of one id are applied in
    order: each field has the value of the last patch that sets it."""
    valid = F.col("status").isNull() | F.col("status").isin(*K.LEAD_STATUSES)
    rejected = patches.where(~valid)
    p = patches.where(valid)
    sets = F.coalesce(F.col("set_notes"), F.lit(False))
    last = p.groupBy("id").agg(F.struct(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("patch_ord"))).alias("status"),
        F.max_by(F.struct("notes"), F.when(sets, F.col("patch_ord")))["notes"].alias("notes"),
        F.max(sets).alias("set_notes")).alias("_p"))
    j = store.join(last, "id", "left")
    hit = F.col("_p").isNotNull()
    cols = []
    for c in S.STORED_LEAD.fieldNames():
        if c == "status":
            cols.append(F.when(hit & F.col("_p.status").isNotNull(), F.col("_p.status")).otherwise(F.col("status")).alias(c))
        elif c == "notes":
            cols.append(F.when(hit & F.col("_p.set_notes"), F.col("_p.notes")).otherwise(F.col("notes")).alias(c))
        elif c == "updated_at":
            cols.append(F.when(hit, _ts(now)).otherwise(F.col("updated_at")).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols), rejected


def delete_leads(store: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """#69: remove the given ids (integers only, duplicates ignored); returns the
    remaining table and a one-row frame with the number removed."""
    good = ids.select(F.col("id").cast("double").alias("_d")) \
              .where(F.col("_d").isNotNull() & (F.col("_d") == F.floor("_d"))) \
              .select(F.col("_d").cast("long").alias("id")).distinct()
    remaining = store.join(good, "id", "left_anti")
    removed = store.join(good, "id", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))
    return remaining, removed


_GLUED = f"^[A-Za-z]+\\z"


def cleanup_leads(store: DataFrame, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """#70: delete microsite domains; rename listicle names from the domain and
    glued names (no whitespace, >9 letters only) by segmentation, when the result
    differs (case-insensitively) and has a space or the old name was a listicle.
    Returns (table, deleted(name, domain), renamed(from, to))."""
    micro = N.is_microsite(F.col("domain"))
    deleted = store.where(micro).select("name", "domain")
    kept = store.where(~micro)
    name = F.col("name")
    listicle = N.looks_like_listicle(name)
    glued = (~name.rlike(WS)) & (F.length(name) > 9) & name.rlike(_GLUED)
    clean = (F.when(listicle, N.clean_name_from_domain(F.col("domain")))
             .when(glued, N.clean_name_from_domain(F.lower(name))))
    rename = clean.isNotNull() & (F.lower(clean) != F.lower(name)) & (clean.contains(" ") | listicle)
    t = kept.withColumn("_clean", clean).withColumn("_rename", F.coalesce(rename, F.lit(False)))
    renamed = t.where("_rename").select(F.col("name").alias("from"), F.col("_clean").alias("to"))
    out = t.withColumn("name", F.when(F.col("_rename"), F.col("_clean")).otherwise(name)) \
           .withColumn("updated_at", F.when(F.col("_rename"), _ts(now)).otherwise(F.col("updated_at"))) \
           .drop("_clean", "_rename")
    return out, deleted, renamed


# ------------------------------------------------------------------ searches and runs

def _search_key(loc: Column) -> Column:
    return F.coalesce(loc, F.lit(""))


def next_id(table: DataFrame, counter: int | None = None) -> int:
    """The id to be given next: the stored counter, which is above every id ever given, or else (or if the table
    has gone beyond it) one more than the highest id of the table."""
    top = int(table.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0])
    return max(top + 1, counter or 1)


def upsert_searches(saved: DataFrame, new: DataFrame, now: str, counter: int | None = None) -> DataFrame:
    """#71: key (niche, location or ''). Existing: lim (default 10), channels
    (empty -> null), label set and reactivated. New: next id in input order
    (``input_ord`` of the key's first input), created now. The last input per key wins.
    ``counter`` is the stored counter of ids (``next_id``); without it the id of a deleted last
    search would be given again."""
    n = new.withColumn("_k", _search_key(F.col("location")))
    last = n.groupBy("niche", "_k").agg(F.max_by(F.struct(*new.columns), F.col("input_ord")).alias("_r"),
                                        F.min("input_ord").alias("first_ord"))
    n = last.select("niche", "_k", "first_ord", *[F.col("_r." + c).alias("n_" + c) for c in new.columns if c != "niche"])
    s = saved.withColumn("_k", _search_key(F.col("location")))
    j = s.join(n, ["niche", "_k"], "full_outer")
    has_old, has_new = F.col("id").isNotNull(), F.col("n_input_ord").isNotNull()
    lim = F.coalesce(F.col("n_lim"), F.lit(K.DEFAULT_LIMIT)).cast("int")
    ch = F.when(F.size(F.col("n_channels")) > 0, F.col("n_channels"))
    base_id = next_id(saved, counter) - 1
    upd = j.where(has_old).select(
        "id", "niche", "location",
        F.when(has_new, lim).otherwise(F.col("lim")).alias("lim"),
        F.when(has_new, ch).otherwise(F.col("channels")).alias("channels"),
        F.when(has_new, F.col("n_label")).otherwise(F.col("label")).alias("label"),
        F.when(has_new, F.lit(True)).otherwise(F.col("active")).alias("active"), "created_at")
    ins = sequential_ids(j.where(~has_old), ["first_ord"], base_id).select(
        F.col("new_id").alias("id"), "niche", F.col("n_location").alias("location"),
        lim.alias("lim"), ch.alias("channels"), F.col("n_label").alias("label"), F.lit(True).alias("active"),
        _ts(now).alias("created_at"))
    return upd.unionByName(ins)


def set_search_active(saved: DataFrame, ids: DataFrame, active: bool) -> DataFrame:
    """#72: toggle ``active`` for the given ids (unknown ids ignored)."""
    hit = saved.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("active", F.when(F.col("_hit"), F.lit(active)).otherwise(F.col("active"))).drop("_hit")


def delete_searches(saved: DataFrame, ids: DataFrame) -> DataFrame:
    """#72: remove searches by id."""
    return saved.join(ids.select("id").distinct(), "id", "left_anti")


def list_searches(saved: DataFrame, active_only: bool = False) -> DataFrame:
    """#73: newest first (ties: insertion order), optionally only active ones."""
    s = saved.where(F.col("active")) if active_only else saved
    return s.orderBy(F.col("created_at").desc(), F.col("id").asc())


def start_run(runs: DataFrame, search_count: int, enrich: bool, now: str, counter: int | None = None) -> tuple[DataFrame, int]:
    """#74: append a ``running`` ledger row; returns (ledger, new run id). ``counter``: the stored counter of ids."""
    new_id = next_id(runs, counter)
    spark = runs.sparkSession
    row = spark.createDataFrame([(new_id, None, None, "running", search_count, 0, enrich, None)], S.RUNS) \
               .withColumn("started_at", _ts(now))
    return runs.unionByName(row), new_id


def finish_run(runs: DataFrame, run_id: int, lead_count: int, now: str, error: str | None = None) -> DataFrame:
    """#74: close a run: finished now, ``done`` or ``error``, lead count, error text."""
    hit = F.col("id") == run_id
    return runs.select(
        "id", "started_at",
        F.when(hit, _ts(now)).otherwise(F.col("finished_at")).alias("finished_at"),
        F.when(hit, F.lit("error" if error else "done")).otherwise(F.col("status")).alias("status"),
        "search_count",
        F.when(hit, F.lit(lead_count)).otherwise(F.col("lead_count")).cast("int").alias("lead_count"),
        "enrich",
        F.when(hit, F.lit(error).cast("string")).otherwise(F.col("error")).alias("error"))


def list_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """#75: newest first, at most ``limit`` rows (a top-k report)."""
    return runs.orderBy(F.col("id").desc()).limit(limit)
