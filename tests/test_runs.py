"""Saved runs: searches one after another, the ledger, errors, counters and the lead table."""

import random

from leadlake.operators import discovery as D
from leadlake.operators import enrich as EN
from leadlake.operators import store as ST
from leadlake.plans import jobs as J
from leadlake.sources import schemas as S

NOW, LATER = "2024-01-01 00:00:00", "2024-01-01 00:05:00"
CANDS = ("spec_ord int, channel string, channel_ord int, ord struct<o1:long,o2:long,o3:long>, name string, website string, domain string, "
         "description string, query string, phone string")


def loop(rows, limits, factor, least):
    """The specs in turn, as the application runs them."""
    taken, out = set(), set()
    for spec, lim in sorted(limits.items()):
        web = [d for _, d in sorted((o, d) for s, ch, _, o, d in rows if s == spec and ch == "web" and d not in taken)][:lim]
        seen = {}
        for s, ch, c, o, d in rows:
            if s == spec and d not in taken and (ch != "web" or d in web):
                seen.setdefault(d, []).append((c, o, ch))
        order = sorted(seen, key=lambda d: (-len({x[2] for x in seen[d]}), min(seen[d])[:2]))
        kept = order[:max(factor * lim, least)]
        out |= {(spec, d, len({x[2] for x in seen[d]})) for d in kept}
        taken |= set(kept)
    return out


def test_the_web_limit_comes_after_the_exclusion(spark):
    r = random.Random(4)
    for _ in range(1):
        limits = {s: r.choice([1, 2, 4]) for s in range(5)}
        rows = []
        for s in limits:
            for c, ch in enumerate(["web", "quora", "g2"]):
                for n, d in enumerate(r.sample(range(25), r.randrange(1, 14))):
                    rows.append((s, ch, c, n, f"d{d}.com"))
        cands = spark.createDataFrame([(s, ch, c, (n, 0, 0), "Name", "w", d, None, "q", None) for s, ch, c, n, d in rows], CANDS)
        specs = spark.createDataFrame(list(limits.items()), "spec_ord int, lim int")
        got = {(x.spec_ord, x.domain, len(x.channels)) for x in D.run_across_specs(cands, specs, 1, 3).collect()}
        assert got == loop(rows, limits, 1, 3)
        early = cands.where("channel <> 'web'")  # the limit taken first would leave later specs fewer
        assert len(got) >= D.run_across_specs(early, specs, 1, 3).count()


def test_no_candidates(spark):
    cands = spark.createDataFrame([], CANDS)
    assert D.run_across_specs(cands, spark.createDataFrame([(0, 5)], "spec_ord int, lim int")).count() == 0


def searches(spark, sf_small, bad):
    """Two fixture specs as saved searches, a switched-off one, and a blank one."""
    specs = J._fx(spark, sf_small, "specs").orderBy("spec_ord").limit(2).collect()
    rows = [(10 + k, s.niche, s.location, 5, None, None, True, f"2024-01-0{k + 1} 00:00:00") for k, s in enumerate(specs)]
    rows += [(20, "off", None, 5, None, None, False, "2024-01-05 00:00:00")] + ([(21, "  ", None, 5, None, None, True, "2024-01-06 00:00:00")] if bad else [])
    df = spark.createDataFrame(rows, "id long, niche string, location string, lim int, channels array<string>, label string, active boolean, created_at string")
    return df.selectExpr("id", "niche", "location", "lim", "channels", "label", "active", "CAST(created_at AS timestamp) AS created_at")


def test_saved_run(spark, sf_small):
    store, runs = spark.createDataFrame([], S.STORED_LEAD), spark.createDataFrame([], S.RUNS)
    data = [J._serp(spark, sf_small), J._fx(spark, sf_small, "places"), J._fx(spark, sf_small, "home_pages")]
    first = EN.saved_run(searches(spark, sf_small, True), runs, store, *data, NOW, LATER, {"next_run_id": 7, "next_lead_id": 100})
    assert first.errors == [{"search": "21", "error": "no niche"}] and (first.search_count, first.run_id) == (3, 7)
    rows = first.leads.collect()
    assert len(rows) == first.lead_count > 0 and len({r.domain for r in rows}) == len(rows)
    assert sorted(r.id for r in rows) == list(range(100, 100 + len(rows)))
    assert first.counters["next_lead_id"] == 100 + len(rows) and first.counters["next_run_id"] == 8
    (row,) = first.runs.collect()
    assert (row.status, row.lead_count, row.search_count, row.error) == ("done", len(rows), 3, None) and str(row.finished_at) == LATER
    # the same searches again: every domain is known; ids go on from the counters
    again = EN.saved_run(searches(spark, sf_small, False), first.runs, first.leads, *data, LATER, None, first.counters)
    known = {r.domain for r in rows}
    new = [r for r in again.leads.collect() if r.domain not in known]
    assert again.lead_count == len(new) and all(r.id >= 100 + len(rows) and r.run_id == 8 for r in new)


def test_a_run_without_searches_and_a_failing_one(spark, sf_small):
    store, runs = spark.createDataFrame([], S.STORED_LEAD), spark.createDataFrame([], S.RUNS)
    none = EN.saved_run(searches(spark, sf_small, False).where("NOT active"), runs, store, store, None, None, NOW)
    assert none.search_count == none.lead_count == 0 and none.runs.first().status == "done" and none.errors == []
    broken = spark.createDataFrame([(1,)], "no_such_column int")
    bad = EN.saved_run(searches(spark, sf_small, False), runs, store, broken, None, None, NOW)
    assert bad.runs.first().status == "error" and bad.runs.first().error and bad.errors[0]["search"] == "*" and bad.leads.count() == 0
    assert ST.list_runs(bad.runs).count() == 1
