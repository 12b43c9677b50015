"""Planning, merge, store and view vectors (FIXTURES.md §3, last table)."""

import datetime as dt

from pyspark.sql import functions as F

from leadlake.functions.contacts import fold_phone
from leadlake.operators import discovery as D
from leadlake.operators import store as ST
from leadlake.operators import views as V
from leadlake.plans import planning as PL
from leadlake.sources import schemas as S


def test_limits(spark):
    df = spark.createDataFrame([(0,), (-5,), (99,), (None,)], "lim int")
    adhoc = [r[0] for r in df.select(PL.clamp_limit(F.col("lim"), "adhoc")).collect()]
    saved = [r[0] for r in df.select(PL.clamp_limit(F.col("lim"), "saved")).collect()]
    assert adhoc == [10, 1, 25, 10] and saved == [10, 10, 50, 10]


def test_web_query_counts(spark):
    specs = spark.createDataFrame([(0, "dentist", "Austin, TX", 10, None), (1, "dentist", "Austin, TX", 25, None),
                                   (2, "dentist", "Austin, TX", 50, None), (3, "dentist", None, 25, None)], S.SPECS)
    n = dict(PL.expand_web_queries(specs).groupBy("spec_ord").count().collect())
    assert [n[i] for i in range(4)] == [5, 13, 15, 8]


def test_cap_sizes(spark):
    m = spark.createDataFrame([(0, f"d{i}", ["web"], (0, (i, 0, 0))) for i in range(80)] +
                              [(1, f"d{i}", ["web"], (0, (i, 0, 0))) for i in range(80)],
                              "spec_ord int, domain string, channels array<string>, "
                              "first_ord struct<c:bigint,o:struct<o1:bigint,o2:bigint,o3:bigint>>")
    specs = spark.createDataFrame([(0, 10), (1, 20)], "spec_ord int, lim int")
    n = dict(D.cap_candidates(m, specs).groupBy("spec_ord").count().collect())
    assert n == {0: 40, 1: 60}


def test_merge_prefers_long_name_and_keeps_phone(spark):
    c = spark.createDataFrame(
        [(0, "web", 0, (0, 0, 0), "A", "https://acme.com", "acme.com", None, "q", None),
         (0, "googlemaps", 6, (0, 0, 0), "Acme", "https://acme.com", "acme.com", "x", "l", "(512) 555-0100")],
        "spec_ord int, channel string, channel_ord int, ord struct<o1:bigint,o2:bigint,o3:bigint>, name string, "
        "website string, domain string, description string, query string, phone string")
    r = D.merge_candidates(c).first()
    assert r["name"] == "Acme" and r["phone"] == "(512) 555-0100" and r["channels"] == ["web", "googlemaps"]
    assert r["query"] == "q"


def test_fold_phone(spark):
    o = ([], ["(512) 555-0100"], [], None, [])
    df = spark.createDataFrame([(o, "512-555-0100"), (o, "+1 512-555-0100"), (None, "1")],
                               f"o {S.OUTREACH.simpleString()}, p string")
    rows = [r[0] for r in df.select(fold_phone(F.col("o"), F.col("p"))["phones"]).collect()]
    assert rows == [["(512) 555-0100"], ["(512) 555-0100", "+1 512-555-0100"], ["1"]]


def _lead_row(i, domain, score, reasons):
    return (i, "n", domain, "https://" + domain, None, "q", [], None, None, score, 0, 0, False, reasons, "won",
            "note", 1, dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 1))


def test_upsert_score_winner(spark):
    store = spark.createDataFrame([_lead_row(1, "a.com", 70, ["old"]), _lead_row(2, "b.com", 70, ["old"])],
                                  S.STORED_LEAD)
    new = spark.createDataFrame([("A", "https://a.com", "a.com", None, "q2", ["web"], None, None, 70, ["new"]),
                                 ("B", "https://b.com", "b.com", None, "q2", None, None, None, 60, ["new"]),
                                 ("C", "https://c.com", "c.com", None, "q2", None, None, None, 5, ["c"])], S.LEAD)
    out = {r["domain"]: r for r in ST.upsert_leads(store, new, 7, "2021-01-01 00:00:00").collect()}
    assert out["a.com"]["score"] == 70 and out["a.com"]["score_reasons"] == ["new"]
    assert out["b.com"]["score"] == 70 and out["b.com"]["score_reasons"] == ["old"]
    assert out["b.com"]["status"] == "won" and out["b.com"]["channels"] == []
    assert out["c.com"]["id"] == 3 and out["c.com"]["status"] == "new"


def test_periods(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 2, 28, 23, 59, 59),)], "created_at timestamp")
    now = "2026-03-01 00:30:00"
    got = {p: df.where(V.filter_period(p, now)).count() == 1 for p in ("today", "yesterday", "week", "month", "year")}
    assert got == {"today": False, "yesterday": True, "week": True, "month": False, "year": True}


def test_csv_cells(spark, tmp_path):
    from leadlake.sources.sinks import export_leads_csv
    df = spark.createDataFrame([('x"y', "p,q", None)], "a string, b string, c string").coalesce(1)
    export_leads_csv(df, str(tmp_path / "o"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*.csv")))
    assert text.splitlines()[1] == '"x""y","p,q",'
