"""Cases in which an earlier version gave wrong answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from leadlake.functions.names import extract_names_listing
from leadlake.functions.urls import host_of, normalize_url
from leadlake.operators import discovery as D
from leadlake.operators import enrich as EN
from leadlake.operators import store as ST
from leadlake.session import publish_table
from leadlake.sources import readers as R
from leadlake.sources import schemas as S
from leadlake.sources import sinks as SK
from leadlake.streaming import streams as SS

NOW = "2024-01-01 00:00:00"


def leads(spark, rows):
    """rows: (domain, name, score, emails)"""
    data = [(n, f"https://{d}", d, None if i % 2 else f"about {n}", "q", ["web"], {"emails": e, "phones": [], "socials": [], "contact_url": None, "people": []},
             None, s, [f"r{s}"], i) for i, (d, n, s, e) in enumerate(rows)]
    by = dict(zip(("name", "website", "domain", "description", "query", "channels", "outreach", "seo", "score", "score_reasons", "input_ord"), range(11)))
    schema = S.T.StructType([f for f in S.LEAD.fields] + [S.T.StructField("input_ord", S.T.LongType())])
    return spark.createDataFrame([tuple(r[by[f.name]] for f in schema.fields) for r in data], schema)


def empty_store(spark):
    return spark.createDataFrame([], S.STORED_LEAD)


def test_column_functions_on_two_frames(spark):
    a = spark.createDataFrame([("http://a.com",)], "url string")
    b = spark.createDataFrame([("http://b.com",)], "url string")
    assert a.select(host_of(a["url"])).first()[0] == "a.com"
    assert b.select(host_of(b["url"])).first()[0] == "b.com"
    assert b.select(host_of(F.col("url"))).first()[0] == "b.com"


def test_hosts_of_odd_urls(spark):
    cases = {"acme.com:8080/x": None, "localhost:3000": None, "mailto:a@b.com": None, "javascript:void(0)": None, "http://a.com:99999/": None,
             "http://a.com:65535/": "a.com", "https:a.com": "a.com", "HTTP://WWW.A.com/x": "a.com", "custom://host/x": "host", "http://a.com:/": "a.com"}
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", host_of(F.col("url")).alias("h"))
    assert {r.url: r.h for r in df.collect()} == cases


def test_accented_niche(spark):
    df = spark.createDataFrame([("Acme Group - CAFÉ, open.", "café")], "d string, n string")
    assert df.select(extract_names_listing(F.col("d"), F.col("n"))).first()[0] == ["Acme Group"]


def test_a_domain_given_twice_is_one_lead(spark):
    new = leads(spark, [("b.com", "B one", 40, ["x@b.com"]), ("a.com", "A", 10, []), ("b.com", "B two", 30, ["y@b.com"])])
    rows = {r.domain: r for r in ST.upsert_leads(empty_store(spark), new, 1, NOW).collect()}
    assert len(rows) == 2 and rows["b.com"].id == 1 and rows["a.com"].id == 2
    b = rows["b.com"]
    assert (b.name, b.score, b.score_reasons, b.outreach.emails) == ("B two", 40, ["r40"], ["x@b.com", "y@b.com"])
    assert b.description == "about B two"
    again = ST.upsert_leads(spark.createDataFrame(list(rows.values()), S.STORED_LEAD), leads(spark, [("b.com", "B three", 40, [])]), 2, NOW)
    r = {x.domain: x for x in again.collect()}["b.com"]
    assert (r.id, r.name, r.score, r.outreach.emails) == (1, "B three", 40, ["x@b.com", "y@b.com"])


def test_ids_follow_the_input_and_the_counter(spark):
    new = leads(spark, [(f"d{k * 7 % 50}.com", "n", 1, []) for k in range(50)])
    rows = ST.upsert_leads(empty_store(spark), new, 1, NOW, next_id=101).collect()
    assert {r.domain: r.id for r in rows} == {f"d{k * 7 % 50}.com": 101 + k for k in range(50)}


def test_patches_of_one_lead_add_up(spark):
    store = ST.upsert_leads(empty_store(spark), leads(spark, [("a.com", "A", 1, [])]), 1, NOW)
    patches = spark.createDataFrame([(1, "won", None, False, 1), (1, None, "call back", True, 2), (1, "nonsense", "x", True, 3)],
                                    "id long, status string, notes string, set_notes boolean, patch_ord int")
    out, rejected = ST.patch_leads(store, patches, NOW)
    assert [(r.status, r.notes) for r in out.collect()] == [("won", "call back")] and rejected.count() == 1


def test_search_ids_follow_the_first_input(spark):
    new = spark.createDataFrame([("a", None, 5, None, "l", 0), ("b", None, 5, None, "l", 1), ("a", None, 9, None, "m", 2)],
                                "niche string, location string, lim int, channels array<string>, label string, input_ord long")
    rows = {r.niche: (r.id, r.lim) for r in ST.upsert_searches(spark.createDataFrame([], S.SEARCHES), new, NOW).collect()}
    assert rows == {"a": (1, 9), "b": (2, 5)}


def test_a_write_never_vanishes(spark, tmp_path):
    df = spark.range(3)
    SK.save_table(df, str(tmp_path), "t", 1)
    with pytest.raises(FileExistsError):
        SK.save_table(df, str(tmp_path), "t", 1)
    (tmp_path / "t" / "v=2").mkdir()  # a broken copy without _SUCCESS
    with pytest.raises(FileExistsError):
        publish_table(df, f"{tmp_path}/t/v=2")
    assert not [p for p in (tmp_path / "t").iterdir() if "tmp" in p.name]


def run_stream(spark, root, rows, name):
    source = f"{root}/in-{name}"
    leads(spark, rows).drop("input_ord").write.parquet(source)
    q = SS.stream_upsert(spark.readStream.schema(S.LEAD).parquet(source), f"{root}/tables", empty_store(spark), 1, None, f"{root}/ckpt-{name}")
    q.awaitTermination()
    assert q.exception() is None


def test_second_stream_goes_on_from_the_newest_version(spark, tmp_path):
    root = str(tmp_path)
    run_stream(spark, root, [("a.com", "A", 1, []), ("a.com", "A2", 1, [])], "one")
    run_stream(spark, root, [("b.com", "B", 2, [])], "two")
    rows = {r.domain: r.id for r in SS.latest_store(spark, f"{root}/tables").collect()}
    assert rows == {"a.com": 1, "b.com": 2}


def test_stream_new_domains_drops_late_rows(spark, tmp_path):
    root = str(tmp_path)
    for k, (url, ts) in enumerate([("http://a.com", "2024-01-01 10:00:00"), ("http://b.com", "2024-01-01 20:00:00"), ("http://third.com", "2024-01-01 20:30:00"),
                                   ("http://late.com", "2024-01-01 11:00:00"), ("http://b.com", "2024-01-01 20:40:00")]):
        spark.createDataFrame([(url, ts)], "url string, ts string").select("url", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{root}/in")
        import time
        time.sleep(0.05)
    st = spark.readStream.schema("url string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    known = spark.createDataFrame([("k.com",)], "domain string")
    q = (SS.stream_new_domains(st, known, delay="1 hour").select("domain").writeStream.format("parquet").option("path", f"{root}/out")
         .option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    assert {r.domain for r in spark.read.parquet(f"{root}/out").collect()} == {"a.com", "b.com", "third.com"}


def test_unknown_providers_and_large_pages(spark, tmp_path):
    import json
    many = [{"url": f"http://h{k}.com", "title": "t"} for k in range(100)]
    with open(tmp_path / "p.json", "w") as f:
        for provider, page, results in (("unheard", 0, many[:1]), ("serper", 0, many), ("serper", 1, many[:5])):
            f.write(json.dumps({"provider": provider, "query": "q", "page": page, "num": 100, "results": results}) + "\n")
    rows = R.read_serp(spark, str(tmp_path / "p.json"))
    best = D.provider_fallback(rows).collect()
    assert len(best) == 105 and len({r["rank"] for r in best}) == 105


def test_limits_are_those_of_the_spec(spark):
    planned = spark.createDataFrame([(0, "web", 0, 0, "q", 100, 100, "n", "", "l")],
                                    "spec_ord int, channel string, channel_ord int, query_ord int, query string, depth int, lim int, niche string, location string, label string")
    serp = spark.createDataFrame([(0, "q", k, f"http://host{k}-firm.com", f"Firm {k}", "") for k in range(1, 81)],
                                 "provider_ord int, query string, rank int, url string, title string, description string")
    assert D.discover_web(planned, serp).count() == 80
    merged = spark.createDataFrame([(0, f"d{k}.com", ["web"], k) for k in range(400)], "spec_ord int, domain string, channels array<string>, first_ord int")
    specs = spark.createDataFrame([(0, 100)], "spec_ord int, lim int")
    assert D.cap_candidates(merged, specs).count() == 300
    assert D.cap_candidates(merged, specs, factor=None).count() == 400


def test_later_specs_fill_up(spark):
    merged = spark.createDataFrame([(s, f"d{k}.com", ["web"], k) for s in range(3) for k in range(60)],
                                   "spec_ord int, domain string, channels array<string>, first_ord int")
    specs = spark.createDataFrame([(s, 10) for s in range(3)], "spec_ord int, lim int")
    counts = {r.spec_ord: r["count"] for r in D.cap_across_specs(merged, specs).groupBy("spec_ord").count().collect()}
    assert counts == {0: 40, 1: 20}


def test_enrichment_of_real_captures(spark):
    cands = spark.createDataFrame([("https://a.com", "a.com"), ("https://b.com", "b.com"), ("https://none.com", "none.com")], "website string, domain string")
    mail = "<title>x</title><p>write to me@a.com</p>"
    pages = spark.createDataFrame([
        (1, "https://A.com/", "http://a.com/", "<p>old</p>", 200), (2, "https://a.com", "http://a.com/", mail, 200), (3, "https://a.com#top", None, "<p>gone</p>", 404),
        (4, "https://b.com/", None, "<p>no address</p>", 200), (5, "https://b.com/contact", None, "<p>b@b.com</p>", 200)],
        "page_id long, url string, final_url string, html string, status_code int")
    rows = {r.domain: r for r in EN.enrich(cands, pages).collect()}
    assert len(rows) == 3
    assert rows["a.com"].outreach.emails == ["me@a.com"] and rows["a.com"].seo.https_ok is False
    assert rows["b.com"].outreach.emails == ["b@b.com"] and rows["b.com"].outreach.contact_url == "https://b.com/contact"
    assert rows["none.com"].outreach is None


def test_normal_urls(spark):
    cases = {"https://A.com": "https://a.com/", "https://a.com:443/x#y": "https://a.com/x", "http://a.com/b/../c?d": "http://a.com/c?d", "nonsense": "nonsense"}
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", normalize_url(F.col("url")).alias("n"))
    assert {r.url: r.n for r in df.collect()} == cases


def test_store_document_in_the_application_s_names(spark, tmp_path):
    import json
    lead = {"id": 3, "name": "A", "domain": "a.com", "website": "https://a.com", "description": None, "query": "q", "channels": ["web"],
            "outreach": {"emails": ["a@a.com"], "phones": [], "socials": [], "contactUrl": "https://a.com/contact", "people": [{"name": "P", "role": "R"}]},
            "seo": {"finalUrl": "https://a.com/", "httpsOk": True, "statusCode": 200, "title": "T", "titleLength": 1, "hasH1": True, "hasOgTitle": False,
                    "wordCount": 7, "issues": ["i"], "opportunityScore": 41},
            "score": 9, "opportunityScore": 41, "issuesCount": 1, "hasEmail": True, "scoreReasons": ["r"], "status": "new", "notes": None, "runId": 1,
            "createdAt": "2024-01-01 00:00:00", "updatedAt": "2024-01-01 00:00:00"}
    path = tmp_path / "store.json"
    path.write_text(json.dumps({"searches": [], "runs": [], "leads": [lead], "nextSearchId": 4, "nextRunId": 2, "nextLeadId": 8}, indent=1))
    _, _, rows = SK.load_store(spark, str(path))
    r = rows.first()
    assert (r.outreach.contact_url, r.seo.final_url, r.seo.https_ok, r.seo.has_h1, r.seo.word_count, r.seo.opportunity_score) == (
        "https://a.com/contact", "https://a.com/", True, True, 7, 41)
    assert tuple(SK.load_counters(spark, str(path)).first()) == (4, 2, 8)
