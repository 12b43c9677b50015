"""The bucketed lead table: commits, replays, compaction, ids; id counters of the store."""

import os

import pytest
from pyspark.sql import functions as F

from leadlake.operators import store as ST
from leadlake.sources import schemas as S
from leadlake.sources.merge_table import LeadTable
from leadlake.streaming import streams as SS

NOW = "2024-01-01 00:00:00"


def leads(spark, rows):
    """(domain, name, score) as leads."""
    df = spark.createDataFrame([(d, n, s, i) for i, (d, n, s) in enumerate(rows)], "domain string, name string, score int, input_ord long")
    for f in S.LEAD.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df.select(*S.LEAD.fieldNames(), "input_ord")


def stored(spark, n):
    empty = spark.createDataFrame([], S.STORED_LEAD)
    return ST.upsert_leads(empty, leads(spark, [(f"d{k}.com", f"D{k}", k % 100) for k in range(n)]), 1, NOW)


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def state(df):
    return {r.domain: (r.id, r.name, r.score, r.run_id) for r in df.collect()}


def test_a_commit_writes_the_rows_it_changes(spark, tmp_path):
    table = LeadTable(spark, f"{tmp_path}/t", 8)
    table.create(stored(spark, 3000))
    want = state(table.read())
    assert len(want) == 3000 and table.state()["next_id"] == 3001
    for k, batch in enumerate([[("d5.com", "new", 99)], [("d5.com", "newer", 1), ("z.com", "Z", 3)], [("a.com", "A", 4), ("a.com", "A2", 2)]], 1):
        assert table.merge(leads(spark, batch), 10 + k, NOW)
        assert size(f"{tmp_path}/t/delta/seq={k}") < size(f"{tmp_path}/t/base") / 5
        assert len(os.listdir(f"{tmp_path}/t/delta/seq={k}")) <= len(batch) + 4  # only the buckets it touches
    want |= {"d5.com": (want["d5.com"][0], "newer", 99, 12), "z.com": (3001, "Z", 3, 12), "a.com": (3002, "A2", 4, 13)}
    assert state(table.read()) == want
    # nothing to do, then all buckets; readers see the same before and after
    assert table.compact(after=5) == 0 and table.compact(after=0) >= 2 and table.compact(after=0) == 0
    assert state(table.read()) == want
    assert table.vacuum() >= 2 and state(LeadTable(spark, f"{tmp_path}/t").read()) == want
    table.merge(leads(spark, [("d5.com", "last", 0)]), 20, NOW)
    assert state(table.read())["d5.com"] == (want["d5.com"][0], "last", 99, 20)


def test_the_same_as_upsert_over_the_whole_table(spark, tmp_path):
    base, new = stored(spark, 200), leads(spark, [(f"d{k * 3}.com", f"N{k}", k) for k in range(100)])
    table = LeadTable(spark, f"{tmp_path}/t", 4)
    table.create(base)
    table.merge(new, 7, NOW)
    whole = ST.upsert_leads(base, new, 7, NOW)
    assert sorted(table.read().collect(), key=lambda r: r.domain) == sorted(whole.collect(), key=lambda r: r.domain)


def test_replays_and_other_writers(spark, tmp_path):
    table, other = (LeadTable(spark, f"{tmp_path}/t", 4) for _ in range(2))
    with pytest.raises(FileNotFoundError):
        table.merge(leads(spark, [("a.com", "A", 1)]), 1, NOW)
    table.create(spark.createDataFrame([], S.STORED_LEAD))
    assert table.read().count() == 0
    batch = leads(spark, [("a.com", "A", 1)])
    assert table.merge(batch, 1, NOW, "q1", 0) and not table.merge(batch, 2, NOW, "q1", 0)
    assert other.merge(leads(spark, [("b.com", "B", 1)]), 1, NOW, "q2", 0) and not table.merge(batch, 3, NOW, "q1", 0)
    table.compact(after=0)
    table.vacuum()
    assert not table.merge(batch, 4, NOW, "q1", 0) and not other.merge(batch, 4, NOW, "q2", 0)
    assert state(table.read()) == {"a.com": (1, "A", 1, 1), "b.com": (2, "B", 1, 1)}
    before = table.state()
    with pytest.raises(FileExistsError):  # both read commit 2, one publishes commit 3
        table.merge(leads(spark, [("c.com", "C", 1)]), 5, NOW)
        table.state = lambda: before
        table.merge(leads(spark, [("e.com", "E", 1)]), 5, NOW)
    assert set(state(other.read())) == {"a.com", "b.com", "c.com"}
    assert table.merge(leads(spark, []), 1, NOW) is True


def test_ids_of_deleted_leads_are_not_given_again(spark, tmp_path):
    table = LeadTable(spark, f"{tmp_path}/t", 4)
    table.create(stored(spark, 5))
    table.replace(ST.delete_leads(table.read(), spark.createDataFrame([(5,), (4,)], "id long"))[0])
    assert sorted(r.id for r in table.read().collect()) == [1, 2, 3]
    table.merge(leads(spark, [("n.com", "N", 1)]), 2, NOW)
    assert state(table.read())["n.com"][0] == 6
    table.replace(table.read().limit(0))
    assert table.read().count() == 0
    # the same for a stream
    leads(spark, [("s.com", "S", 1)]).drop("input_ord").write.parquet(f"{tmp_path}/in")
    root = f"{tmp_path}/st"
    LeadTable(spark, f"{root}/leads", 4).create(stored(spark, 2), next_id=9)
    q = SS.stream_upsert(spark.readStream.schema(S.LEAD).parquet(f"{tmp_path}/in"), root, stored(spark, 1), 1, NOW, f"{tmp_path}/ckpt")
    q.awaitTermination()
    assert q.exception() is None and state(SS.latest_store(spark, root))["s.com"][0] == 9


def test_counters_of_searches_and_runs(spark):
    searches = ST.upsert_searches(spark.createDataFrame([], S.SEARCHES), spark.createDataFrame(
        [("a", None, 5, None, "l", 0), ("b", None, 5, None, "l", 1)], "niche string, location string, lim int, channels array<string>, label string, input_ord long"), NOW)
    runs, first = ST.start_run(spark.createDataFrame([], S.RUNS), 1, True, NOW)
    kept = ST.counters(searches, runs, stored(spark, 3))
    assert kept == {"next_search_id": 3, "next_run_id": 2, "next_lead_id": 4} and first == 1
    left = ST.delete_searches(searches, spark.createDataFrame([(2,)], "id long"))
    assert ST.counters(left, runs.limit(0), stored(spark, 3).limit(0), kept) == kept
    new = spark.createDataFrame([("c", None, 5, None, "l", 0)], "niche string, location string, lim int, channels array<string>, label string, input_ord long")
    assert {r.niche: r.id for r in ST.upsert_searches(left, new, NOW, kept["next_search_id"]).collect()} == {"a": 1, "c": 3}
    assert ST.start_run(runs.limit(0), 1, True, NOW, kept["next_run_id"])[1] == 2
    up = ST.upsert_leads(stored(spark, 3).where("id < 3"), leads(spark, [("n.com", "N", 1)]), 1, NOW, next_id=kept["next_lead_id"])
    assert {r.domain: r.id for r in up.collect()}["n.com"] == 4
