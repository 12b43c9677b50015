"""Subtotals, sketches, ranks, quantiles and change history against plain Python."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from leadlake.operators import history as H
from leadlake.operators import summaries as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def leads(spark):
    r = random.Random(5)
    rows = [(i, r.choice(["x", "y", None]), r.choice(["p", None]), r.choice(["new", "won"]), r.choice([None, *range(101)]), r.random() < 0.5) for i in range(400)]
    return rows, spark.createDataFrame(rows, "id long, a string, b string, status string, score int, has_email boolean")


def totals(rows, keep):
    out = {}
    for r in rows:
        key = tuple(r[1 + d] if d in keep else None for d in range(3))
        out.setdefault(key, []).append(r)
    scores = {k: [r[4] for r in v if r[4] is not None] for k, v in out.items()}
    return {k: (len(v), sum(r[5] for r in v), sum(s >= 70 for s in scores[k]), sum(scores[k]) / len(scores[k]) if scores[k] else None) for k, v in out.items()}


@pytest.mark.parametrize("cube", [False, True])
def test_subtotals_tell_null_from_total(spark, cube):
    rows, df = leads(spark)
    got = (S.lead_cube(df, ["a", "b", "status"]) if cube else S.lead_funnel(df, ["a", "b"])).collect()
    sets = [c for n in range(4) for c in combinations(range(3), n)] if cube else [(0, 1, 2), (0, 1), (0, 2), (0,), (2,), ()]
    want = {}
    for keep in sets:
        gid = sum(1 << (2 - d) for d in range(3) if d not in keep)
        want.update({(gid, *k): v for k, v in totals(rows, keep).items()})
    assert {(g.grouping_id, g.a, g.b, g.status): (g.leads, g.with_email, g.hot, g.avg_score) for g in got} == want
    assert all((g.a_is_total, g.b_is_total, g.status_is_total) == tuple(bool(g.grouping_id >> (2 - d) & 1) for d in range(3)) for g in got)


def test_subtotals_of_no_rows(spark):
    _, df = leads(spark)
    assert S.lead_funnel(df.limit(0), ["a", "b"]).where("grouping_id < 7").collect() == []


def test_sketches_merge_in_any_order(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("channel"), (F.col("id") % 24).alias("hour"),
                                    F.concat(F.lit("d"), (F.col("id") * 7919 % 20_011).cast("string")).alias("domain"))
    hourly = S.distinct_sketches(df, ["channel", "hour"], "domain")
    a = S.merged_sketches(hourly, ["channel"])
    b = S.merged_sketches(S.merged_sketches(hourly.orderBy(F.col("hour").desc()), ["channel", (F.col("hour") < 7).alias("early")]), ["channel"])
    whole = S.distinct_sketches(df, ["channel"], "domain")
    est = [{r.channel: r.n for r in x.select("channel", S.distinct_estimate().alias("n")).collect()} for x in (a, b, whole)]
    assert est[0] == est[1]
    for r in df.groupBy("channel").agg(F.count_distinct("domain").alias("n")).collect():
        assert all(abs(e[r.channel] - r.n) <= 0.06 * r.n for e in est)
    assert S.merged_sketches(hourly.limit(0), ["channel"]).collect() == []


def test_sketches_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    df = spark.range(5_000).select((F.col("id") % 2).alias("channel"), F.concat(F.lit("d"), (F.col("id") % 997).cast("string")).alias("domain"))
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    st = spark.readStream.schema("channel long, domain string").option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")

    def store(batch, n):
        S.distinct_sketches(batch, ["channel"], "domain").write.mode("overwrite").parquet(f"{tmp_path}/sketches/batch={n}")

    q = st.writeStream.foreachBatch(store).option("checkpointLocation", f"{tmp_path}/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    merged = S.merged_sketches(spark.read.parquet(f"{tmp_path}/sketches"), ["channel"]).select("channel", S.distinct_estimate().alias("n"))
    assert {r.channel: abs(r.n - 997) <= 60 for r in merged.collect()} == {0: True, 1: True}


@pytest.mark.parametrize("n,buckets", [(0, 4), (3, 10), (100, 10), (103, 10), (1, 1)])
def test_ntile(spark, n, buckets):
    df = spark.range(n).select("id", (F.col("id") % 5).alias("score"))
    got = {r.id: r.bucket for r in S.global_ntile(df, [F.col("score").desc(), F.col("id")], buckets).collect()}
    order = sorted(range(n), key=lambda i: (-(i % 5), i))
    size, more = divmod(n, buckets)
    want = [b + 1 for b in range(buckets) for _ in range(size + (b < more))]
    assert got == dict(zip(order, want))


def test_ntile_has_no_window_over_all_rows(spark):
    df = spark.range(1000).select("id", (F.col("id") % 5).alias("score"))
    p = plan(S.global_ntile(df, ["score", "id"], 10))
    lines = [x for x in p.splitlines() if "SinglePartition" in x]
    assert len(lines) <= 2 and p.count("Window") <= 2  # the counts of the partitions only
    assert "rangepartitioning" not in p  # cut off by the checkpoint


def test_quantiles(spark):
    r = random.Random(9)
    values = [r.choice([1.0, 1.0, 2.5, r.random() * 10]) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    ps = [0.0, 0.1, 0.5, 0.999, 1.0]
    got = {q.probability: q.value for q in S.quantiles(df, "v", ps).collect()}
    import numpy as np
    assert all(abs(got[p] - np.quantile(values, p)) < 1e-12 for p in ps)
    assert [q.value for q in S.quantiles(df.limit(0), "v", [0.5]).collect()] == [None]


V = "id long, status string, notes string"


def test_any_version_can_be_rebuilt(spark):
    r = random.Random(3)
    tables, cur = {}, {}
    for v in range(6):
        for i in range(40):
            p = r.random()
            if p < 0.2:
                cur[i] = (r.choice(["new", "won", None]), r.choice(["", None, "n"]))
            elif p < 0.3:
                cur.pop(i, None)
        tables[v * 2 + 1] = dict(cur)
    frames = {v: spark.createDataFrame([(i, *x) for i, x in t.items()], V) for v, t in tables.items()}
    log = H.change_log(frames, "id").checkpoint()
    p = H.periods(log, "id")
    for v, t in tables.items():
        back = H.version_at(p, v, ["id", "status", "notes"]).collect()
        assert {(x.id, x.status, x.notes) for x in back} == {(i, *x) for i, x in t.items()} and len(back) == len(t)
    assert H.version_at(p, 0, ["id"]).count() == 0
    # a null and an empty note differ, an unchanged row has no entry
    a, b = (spark.createDataFrame([(1, "new", None), (2, "new", n), (None, "x", "y")], V) for n in ("", None))
    assert [(x.id, x.change) for x in H.changes(a, b, "id").collect()] == [(2, "update")]


def test_join_on_the_key_only_once_per_difference(spark):
    a = spark.createDataFrame([(1, "new", None)], V)
    p = plan(H.changes(a, a, "id"))
    assert p.count("FullOuter") == 1 and "Cartesian" not in p and "NestedLoop" not in p
