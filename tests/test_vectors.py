"""Hand-derived vectors (FIXTURES.md §3), one per branch."""

from pyspark.sql import functions as F

from leadlake.functions import contacts as C
from leadlake.functions import html as H
from leadlake.functions import names as N
from leadlake.functions.scoring import score_lead
from leadlake.functions.seo import audit_seo
from leadlake.functions.urls import host_of, parse_url_parts


def one(spark, col, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)) if cols \
        else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def audit(spark, url="http://a.com", status=200, title=None, og_title=None, desc=None, og_desc=None,
          og_image=None, favicon=None, text=""):
    df = spark.createDataFrame([(url, status, title, og_title, desc, og_desc, og_image, favicon, text)],
                               "u string, s int, t string, ot string, d string, od string, oi string, f string, x string")
    a = audit_seo(final_url=F.col("u"), status_code=F.col("s"), title=F.col("t"), og_title=F.col("ot"),
                  description=F.col("d"), og_description=F.col("od"), og_image=F.col("oi"), favicon=F.col("f"),
                  text=F.col("x"), requested_url=F.col("u"))
    return df.select(a.alias("a")).first()["a"]


def test_audit_all_missing(spark):
    a = audit(spark)
    assert a["opportunity_score"] == 81 and len(a["issues"]) == 6


def test_audit_clean(spark):
    text = "# Hi " + " ".join(["w"] * 300)
    a = audit(spark, url="https://a.com", title="t" * 45, desc="d" * 100, og_title="x", og_image="i.png",
              favicon="f.ico", text=text)
    assert a["opportunity_score"] == 0 and a["issues"] == []


def test_audit_title_lengths(spark):
    pts = [audit(spark, url="https://a.com", title="t" * n, desc="d" * 100, og_title="x", og_image="i",
                 favicon="f", text="# H")["opportunity_score"] - 10 for n in (29, 30, 60, 61)]
    assert pts == [8, 0, 0, 6]


def test_audit_description_lengths(spark):
    pts = [audit(spark, url="https://a.com", title="t" * 45, desc="d" * n, og_title="x", og_image="i",
                 favicon="f", text="# H")["opportunity_score"] - 10 for n in (69, 70, 160, 161)]
    assert pts == [8, 0, 0, 5]


def test_audit_word_counts(spark):
    def thin(n):
        text = " ".join(["w"] * n)
        a = audit(spark, url="https://a.com", title="t" * 45, desc="d" * 100, og_title="x", og_image="i",
                  favicon="f", text=text)
        return 10 if any(i.startswith("Thin content") for i in a["issues"]) else 0
    assert [thin(n) for n in (0, 1, 249, 250)] == [0, 10, 10, 0]
    a = audit(spark, url="https://a.com", text="a b c")
    assert "Thin content (~3 words on homepage)" in a["issues"]


def test_audit_everything_wrong_capped(spark):
    a = audit(spark, status=500, text="a b c")
    assert a["opportunity_score"] == 100 and len(a["issues"]) == 8


def test_audit_title_falls_back_to_og(spark):
    a = audit(spark, title="  ", og_title="Acme")
    assert a["title"] == "Acme" and "Title too short (4 chars)" in a["issues"]


def score(spark, opp, issues, status, outreach):
    seo = None if opp is None else (opp, issues, status)
    df = spark.createDataFrame(
        [(seo, outreach)],
        "seo struct<opportunity_score:int,issues:array<string>,status_code:int>, "
        "o struct<emails:array<string>,phones:array<string>,socials:array<string>,"
        "contact_url:string,people:array<struct<name:string,role:string>>>")
    return df.select(score_lead(F.col("seo"), F.col("o")).alias("s")).first()["s"]


def test_scores(spark):
    empty = ([], [], [], None, [])
    assert score(spark, 81, ["i"] * 6, 200, empty)["score"] == 54
    s = score(spark, 0, [], 200, None)
    assert s["score"] == 5 and s["reasons"] == ["Clean SEO — weaker pitch (+0)"]
    assert score(spark, 100, ["i"], 500, None)["score"] == 60
    assert score(spark, None, None, None, ([], ["p"], [], None, []))["score"] == 10
    assert score(spark, None, None, None, (["e"], ["p"], ["s"], None, []))["score"] == 32
    assert score(spark, None, None, None, (["e"], ["p"], ["s"], None, [("n", None)]))["score"] == 35
    assert score(spark, 100, ["i"], None, (["e"], ["p"], ["s"], None, [("n", None)]))["score"] == 100


def test_hosts(spark):
    h = lambda u: one(spark, host_of(F.lit(u)))
    assert h("https://www.Acme.com/x") == "acme.com"
    assert h("acme.com") is None
    assert h("https://my_shop.acme.com/") == "my_shop.acme.com"
    agg = lambda x: one(spark, N.is_aggregator(F.lit(x)))
    assert [agg(x) for x in ("m.yelp.com", "yelp.com.au", "x.com", "notyelp.com", "box.com")] == \
        [True, True, True, False, False]
    mic = lambda x: one(spark, N.is_microsite(F.lit(x)))
    assert mic("acme.square.site") and not mic("square.site.com")


def test_names(spark):
    clean = lambda h: one(spark, N.clean_name_from_domain(F.lit(h)))
    assert clean("smith-plumbing.com") == "Smith Plumbing"
    assert clean("smithplumbing.com") == "Smith Plumbing"
    assert clean("acme.com") == "Acme"
    assert clean("northstar.com") == "Northstar"
    assert clean("familydentalandair.com") == "Family Dental And Air"
    lst = lambda t: one(spark, N.looks_like_listicle(F.lit(t)))
    assert [lst(t) for t in ("Top 10 Dentists", "Acme, TX", "10 best gyms")] == [True, True, True]
    assert [lst(t) for t in ("Topeka", "Bestway", "Acme, tx")] == [False, False, False]
    assert lst("écheap")  # ASCII word boundary, as in JavaScript (the JDK's \\b would not match)
    pick = lambda t, h: one(spark, N.pick_name(F.lit(t), F.lit(h)))
    assert pick("Acme Roofing | Denver", "acmeroofing.com") == "Acme Roofing"
    assert pick("Best Plumbers in Austin, TX", "smithplumbing.com") == "Smith Plumbing"
    assert pick("Home - Acme", "acme.com") == "Acme"
    assert one(spark, N.derive_name(F.lit(None).cast("string"), F.lit("foo-bar.com"))) == "Foo Bar"
    comp = lambda t: one(spark, N.extract_company_name(F.lit(t)))
    assert comp("Acme Corp - Overview | LinkedIn") == "Acme Corp"
    assert comp("Acme | Clutch.co") == "Acme"
    assert comp("HubSpot Reviews 2024: Details, Pricing") == "HubSpot"
    assert comp("Top Agencies") is None and comp("Theory Labs") is None
    dm = lambda h, n: one(spark, N.domain_matches_name(F.lit(h), F.lit(n)))
    assert dm("acmeroofing.com", "Acme Roofing") and dm("claygroup.com", "Clay")
    assert not dm("leviclay.com", "Clay")
    assert one(spark, N.extract_names_listing(F.lit("From Business: Acme Air is a family company"),
                                              F.lit("plumber"))) == ["Acme Air"]
    assert one(spark, N.extract_names_bullets(F.lit("Semrush (1,234) · Ahrefs · Keyword Tools · best"))) == \
        ["Semrush", "Ahrefs"]
    assert one(spark, N.extract_names_bullets(F.lit("tools like Moz, Ahrefs, and Semrush"))) == \
        ["Moz", "Ahrefs", "Semrush"]


def test_extraction(spark):
    assert one(spark, H.meta_content(F.lit('<meta name="description" content="Bob\'s shop">'), "description")) == "Bob"
    assert one(spark, H.extract_title(F.lit("<title></title>"))) is None
    html = '<a href="/p">a</a><a href="https://b.com">b</a><a href="y#z">c</a><a href="mailto:q@r.co">d</a>'
    links = one(spark, H.extract_links(F.lit(html), parse_url_parts(F.lit("https://a.com/x/"))))
    assert links["internal"] == ["https://a.com/p"] and links["external"] == ["https://b.com/"]
    assert one(spark, C.extract_emails(F.lit("x@y.com X@y.com x@y.com"))) == ["x@y.com", "X@y.com"]
    assert one(spark, C.extract_phones(F.lit("(512) 555-0100 5125550100"))) == ["(512) 555-0100", "5125550100"]
    assert one(spark, C.is_social(F.lit("https://netflix.com/a")))
    assert not one(spark, C.is_social(F.lit("https://netflix.com/a"), "host"))


def test_url_resolution(spark):
    b = parse_url_parts(F.lit("http://Ex.com:80/a/b/c?q=1"))
    from leadlake.functions.urls import resolve_url
    r = lambda h: one(spark, resolve_url(F.lit(h), b, base_parsed=True)["url"])
    assert r("../d") == "http://ex.com/a/d"
    assert r("./") == "http://ex.com/a/b/"
    assert r("?z=2") == "http://ex.com/a/b/c?z=2"
    assert r("//cdn.ex.com/x y") == "http://cdn.ex.com/x%20y"
    assert r("HTTPS://Other.com:443") == "https://other.com/"
    assert r("ftp://x.com/") is None


def test_meta_tags_hold_what_the_page_holds(spark):
    import random
    from leadlake.functions import html as H
    r = random.Random(8)
    bits = ["<meta ", "<META ", "name=", "property=", "content=", '"', "'", "description", "og:title", "icon", "x y", ">", "> ", " ", "a>b", "\n"]
    pages = ["".join(r.choice(bits) for _ in range(r.randrange(60))) for _ in range(1500)]
    attrs = ['name="description"', "property='og:title'", 'name="icon"', 'content="one"', "content='two > 2'", "content=''", "charset=x"]
    pages += ["".join("<meta " + " ".join(r.sample(attrs, r.randrange(1, 6))) + r.choice([">", "/>"]) for _ in range(r.randrange(1, 5))) for _ in range(1500)]
    df = spark.createDataFrame([(p,) for p in pages], "html string")
    df = df.withColumn("metas", H.meta_tags(F.col("html")))
    for key in ("description", "og:title", "icon"):
        bad = df.where(~H.meta_content(F.col("html"), key).eqNullSafe(H.meta_content(F.col("metas"), key)))
        assert bad.count() == 0, (key, bad.first())
