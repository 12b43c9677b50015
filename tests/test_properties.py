"""Properties: idempotence, partition independence, bounds, stream = batch."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leadlake.functions import names as N
from leadlake.functions.urls import host_of
from leadlake.operators import discovery as D
from leadlake.operators import store as ST
from leadlake.plans import jobs as J


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_upsert_is_idempotent(spark, sf_small):
    store = J._sfx(spark, sf_small, "leads")
    new = J._sfx(spark, sf_small, "new_leads")
    once = ST.upsert_leads(store, new, 9, "1999-06-15 12:00:00")
    twice = ST.upsert_leads(once, new, 9, "1999-06-15 12:00:00")
    cols = ["id", "domain", "score", "status"]
    assert _rows(once.select(*cols)) == _rows(twice.select(*cols))


def test_merge_independent_of_partitioning(spark, sf_small):
    c = J._channels(spark, sf_small).cache()
    a = D.merge_candidates(c).select("spec_ord", "domain", "name", "channels")
    b = D.merge_candidates(c.repartition(7, "name")).select("spec_ord", "domain", "name", "channels")
    assert _rows(a) == _rows(b)


def test_audit_bounds_and_no_blocked_hosts(spark, sf_small):
    s = J.JOBS["audit_seo"](spark, sf_small)
    assert s.where((F.col("opportunity_score") < 0) | (F.col("opportunity_score") > 100)).count() == 0
    c = J._channels(spark, sf_small)
    assert c.where(N.is_blocked(F.col("domain"))).count() == 0


def test_stream_equals_batch(spark, sf_small):
    a = J.JOBS["stream_enrich"](spark, sf_small).select("page_id", "score", "issues")
    b = J.JOBS["score_pages"](spark, sf_small).select("page_id", "score", "issues")
    assert _rows(a) == _rows(b)


def test_stream_upsert_equals_batch(spark, sf_small):
    a = J.JOBS["stream_upsert"](spark, sf_small).select("id", "domain", "score", "reasons", "emails")
    b = J.JOBS["upsert_leads"](spark, sf_small).select("id", "domain", "score", "reasons", "emails")
    assert _rows(a) == _rows(b)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["yelp.com", "acme.com", "m.yelp.com", "yelp.com.au", "a.square.site",
                                 "square.site.com", "x.com", "netflix.com", "www.bbb.org"]), min_size=1, max_size=6))
def test_join_blocklist_equals_expression(spark, hosts):
    from leadlake.sources.dims import blocklist
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    a = D.exclude_blocked(D.exclude_blocked(df, "host", blocklist(spark, "aggregator")), "host",
                          blocklist(spark, "microsite"), prefixes=False)
    b = df.where(~N.is_blocked(F.col("host")))
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())


@settings(max_examples=20, deadline=None)
@given(st.from_regex(r"https?://(www\.)?[a-z]{1,8}\.(com|org)(:[0-9]{2,4})?(/[a-z]{0,5}){0,2}", fullmatch=True))
def test_host_of_matches_python(spark, url):
    from urllib.parse import urlsplit
    expect = urlsplit(url).hostname
    expect = expect[4:] if expect.startswith("www.") else expect
    got = spark.createDataFrame([(url,)], "u string").select(host_of(F.col("u"))).first()[0]
    assert got == expect
