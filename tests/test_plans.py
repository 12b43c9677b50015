"""Plan-shape checks: pushdown/pruning on scans, no Python UDFs, dimension broadcasts."""

from pyspark.sql import functions as F

from leadlake.operators import views as V
from leadlake.plans import jobs as J


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_prunes_columns_and_has_no_python(spark, sf_small):
    from leadlake.operators.pages import score_pages
    from leadlake.sources.readers import read_pages
    p = plan(score_pages(read_pages(spark, f"{sf_small}/pages.parquet")))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p
    assert "ReadSchema: struct<page_id:bigint,url:string,html:string>" in p


def test_lead_filters_push_down(spark, sf_small):
    leads = J._sfx(spark, sf_small, "leads")
    df = V.list_leads(leads, V.LeadFilter(status="won", min_score=50))
    p = plan(df)
    assert "PushedFilters" in p and "EqualTo(status,won)" in p and "GreaterThanOrEqual(score,50)" in p


def test_no_python_anywhere(spark, sf_small):
    for name in ("run_search", "upsert_leads", "discover_channels", "lead_stats"):
        p = plan(J.JOBS[name](spark, sf_small))
        assert "EvalPython" not in p, name


def test_prepared_hits_read_wide_columns_once(spark, tmp_path):
    from leadlake.operators.discovery import prepare_hits
    rows = [(q, p, r, f"https://h{p}{r}.com/{q}", f"t{q}{p}{r}", None)
            for q, ps in (("a", (0, 1)), ("b", (1, 2)), ("c", (0,))) for p in ps for r in (1, 2, 3)]
    rows += [("b", 1, 1, "https://again.com", "second of rank 1", None), (None, 0, 1, "https://n.com", "no query", None),
             ("a", None, 1, "https://x.com", "no provider", None)]
    path = str(tmp_path / "hits")
    spark.createDataFrame(rows, "query string, provider_ord int, rank int, url string, title string, description string").write.parquet(path)
    # a query may be wanted several times: its largest depth counts
    wanted = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("none", 5), (None, 5)], "query string, depth int")
    got = prepare_hits(spark.read.parquet(path), wanted)
    p = plan(got)  # before the run: an executed adaptive plan prints its first form too
    best = {"a": (0, 2), "b": (1, 1)}
    expected = sorted((q, r, u, t) for q, prov, r, u, t, _ in rows if q in best and prov == best[q][0] and r <= best[q][1])
    assert sorted((x["query"], x["rank"], x["url"], x["title"]) for x in got.collect()) == expected
    scans = [line for line in p.splitlines() if "ReadSchema" in line]
    assert sum("title" in line.split("ReadSchema")[1] for line in scans) == 1, p
    assert "CartesianProduct" not in p and "Window" not in p


def test_no_cross_joins(spark, sf_small):
    for name in ("discover_web", "resolve_websites", "lead_stats", "list_leads", "scrape_report", "audit_seo"):
        p = plan(J.JOBS[name](spark, sf_small))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_stored_url_key_is_used(spark):
    from leadlake.operators.enrich import with_url_key
    pages = spark.createDataFrame([("HTTPS://A.com", "x")], "url string, html string")
    keyed = with_url_key(pages)
    assert keyed.first()["url_key"] == "https://a.com/"
    assert with_url_key(keyed) is keyed and with_url_key(keyed.drop("url")).columns == ["html", "url_key"]
