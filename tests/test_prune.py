"""Wide tables are pruned in the scan: what no query, candidate or fixture wants crosses no shuffle."""

import pytest
from pyspark.sql import functions as F

from leadlake import fixtures as FX
from leadlake.operators import discovery as D
from leadlake.operators import enrich as EN
from leadlake.operators.prune import prune

HITS = "query string, provider_ord int, rank int, url string, title string, description string"


@pytest.fixture
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def shuffled_before_pruning(df, column):
    """Whether ``column`` reaches an exchange straight from the scan, without a broadcast join between."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and column in x.split("ReadSchema")[1])
    above = next(x for x in reversed(lines[:scan]) if "Exchange" in x or "BroadcastHashJoin" in x)
    return "BroadcastHashJoin" not in above


def test_prune_keeps_all_rows_of_the_keys(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 1), ("a", 1), ("a", 2), ("b", None), ("c", 1)], "k string, n int")
    keys = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), ("none", 7)], "k string, n int").checkpoint()
    got = sorted((r.k, r.n or 0) for r in prune(rows, ["k", "n"], keys).collect())
    assert got == [("a", 1), ("a", 1), ("b", 0)]
    assert prune(rows, ["k", "n"], keys, limit=3).count() == 6  # left to the exact join
    assert prune(rows, ["k", "n"], keys.limit(0)).count() == 0


def test_other_hits_are_not_shuffled(spark, tmp_path, no_auto_broadcast):
    rows = [(f"q{i}", 0, 1, f"https://h{i}.com/", f"t{i}", "") for i in range(50)]
    spark.createDataFrame(rows, HITS).write.parquet(str(tmp_path / "hits"))
    wanted = spark.createDataFrame([("q7", 1), ("q8", 0)], "query string, depth int")
    got = D.prepare_hits(spark.read.parquet(str(tmp_path / "hits")), wanted)
    assert not shuffled_before_pruning(got, "title")
    assert [(r["query"], r.host) for r in got.collect()] == [("q7", "h7.com")]


def test_html_of_other_pages_is_not_shuffled(spark, tmp_path, no_auto_broadcast):
    rows = [(i, f"HTTPS://h{i}.com:443", "<title>T</title>") for i in range(50)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    urls = spark.createDataFrame([("https://h3.com",), ("https://h3.com/",), ("https://none.com",), (None,)], "url string")
    got = EN._wanted(spark.read.parquet(str(tmp_path / "pages")), urls)
    assert not shuffled_before_pruning(got, "html")
    assert [(r.page_id, r.url_key) for r in got.collect()] == [(3, "https://h3.com/")]


def test_base_pages_are_read_once_and_dealt_out(spark, tmp_path):
    rows = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("https://h"), F.col("id") % 9, F.lit(".com/")).alias("url"),
                                   F.lit("<title>T</title>").alias("html"))
    rows.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    base = str(tmp_path)
    for made in (FX.home_pages(spark, base), FX.known(spark, base), FX.page_titles(spark, base)):
        files = made.inputFiles()
        assert len(files) == FX.FILES and not any(base in f for f in files)
    assert FX.pages(spark, base).exceptAll(spark.read.parquet(f"{base}/pages.parquet")).count() == 0
    assert FX.home_pages(spark, base).count() == 400
