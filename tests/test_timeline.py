"""Joins along time, sessions and follow-ups against plain Python, plan shape, late rows and restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from leadlake.operators import timeline as T
from leadlake.streaming import streams as SS

DAY = dt.datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else DAY + dt.timedelta(minutes=minutes)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(seed, n, keys, span=300):
    r = random.Random(seed)
    return [(i, r.choice(keys), at(r.choice([None, *range(span)]) if r.random() < 0.1 else r.randrange(span))) for i in range(n)]


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("per_slice", [100_000, 7])
def test_asof_join(spark, strict, forward, per_slice):
    left, right = rows(1, 300, ["a", "a", "a", "b", None, "only left"]), rows(2, 200, ["a", "a", "b", None, "only right"])
    l, r = spark.createDataFrame(left, "i long, k string, t timestamp"), spark.createDataFrame(right, "j long, k string, u timestamp")
    got = {x.i: (x.j, x.u) for x in T.asof_join(l, r, "k", "t", "u", ["j", "u"], "j", strict, forward, per_slice).collect()}
    assert len(got) == 300
    for i, k, t in left:
        ok = [(u, j) for j, k2, u in right if k is not None and k == k2 and t and u
              and ((u > t if strict else u >= t) if forward else (u < t if strict else u <= t))]
        best = None
        if ok:
            edge = (min if forward else max)(u for u, _ in ok)
            best = (max(j for u, j in ok if u == edge), edge)
        assert got[i] == (best or (None, None)), (i, k, t)


def test_asof_repeated_and_no_rows(spark):
    l = spark.createDataFrame([(1, "a", at(5))] * 3, "i long, k string, t timestamp")
    r = spark.createDataFrame([], "j long, k string, u timestamp")
    assert [x.j for x in T.asof_join(l, r, "k", "t", "u", ["j"], "j").collect()] == [None] * 3
    assert T.asof_join(l.limit(0), l.select(F.col("i").alias("j"), "k", F.col("t").alias("u")), "k", "t", "u", ["j"], "j").collect() == []


def spans(seed, n, longest):
    r = random.Random(seed)
    out = []
    for i in range(n):
        s = r.randrange(5000)
        e = s + r.choice([0, 0, 1, 60, r.randrange(longest), -3])
        out.append((i, r.choice(["a", "a", "b", None]), at(None if r.random() < 0.03 else s), at(e)))
    return out


@pytest.mark.parametrize("longest", [50, 100_000])
def test_interval_join(spark, longest):
    left, right = spans(3, 250, longest), spans(4, 250, longest)
    l = spark.createDataFrame(left, "i long, k string, s timestamp, e timestamp")
    r = spark.createDataFrame(right, "j long, k string, u timestamp, v timestamp")
    want = sorted((i, j) for i, k, s, e in left for j, k2, u, v in right
                  if k and k == k2 and s and u and s <= e and u <= v and s <= v and u <= e)
    j = T.interval_join(l, r, ["k"], ("s", "e"), ("u", "v"), bin_seconds=600)
    assert sorted((x.i, x.j) for x in j.collect()) == want and len(want) > 100
    assert "Cartesian" not in plan(j) and "NestedLoop" not in plan(j)
    alone = T.interval_join(l.drop("k"), r.drop("k"), [], ("s", "e"), ("u", "v"), bin_seconds=600)
    want = sum(1 for _, _, s, e in left for _, _, u, v in right if s and u and s <= e and u <= v and s <= v and u <= e)
    assert alone.count() == want and "Cartesian" not in plan(alone) and "NestedLoop" not in plan(alone)


def test_long_intervals_are_in_few_bins(spark):
    l = spark.createDataFrame([(i, at(0), at(10_000_000)) for i in range(5)], "i long, s timestamp, e timestamp")
    r = spark.createDataFrame([(j, at(j * 1000), at(j * 1000)) for j in range(50)], "j long, u timestamp, v timestamp")
    j = T.interval_join(l, r, [], ("s", "e"), ("u", "v"), bin_seconds=60)
    assert j.count() == 250 and "Cartesian" not in plan(j)


def test_sessions(spark):
    events = [("a", 0), ("a", 30), ("a", 90), ("a", 151), ("b", 0), (None, 1), (None, 2), ("a", None)]
    df = spark.createDataFrame([(k, at(m)) for k, m in events], "k string, t timestamp")
    got = sorted(((x.k, x.session_start, x.session_end, x.n_events) for x in T.sessions(df, "k", "t", "60 minutes").collect()), key=repr)
    # rows exactly a gap apart (30 and 90) are in one session
    assert got == sorted([("a", at(0), at(150), 3), ("a", at(151), at(211), 1), ("b", at(0), at(60), 1), (None, at(1), at(62), 2)], key=repr)


def fed(spark, base, *batches):
    for b in batches:
        spark.createDataFrame([(k, at(m), kind) for k, m, kind in b], "k string, t timestamp, kind string").coalesce(1).write.mode("append").parquet(base + "/in")
    return spark.readStream.schema("k string, t timestamp, kind string").option("maxFilesPerTrigger", 1).parquet(base + "/in")


def run(df, base):
    q = df.writeStream.format("parquet").option("path", base + "/out").option("checkpointLocation", base + "/ckpt").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_late_rows_and_sessions_of_a_stream(spark, tmp_path):
    base = str(tmp_path)
    st = fed(spark, base, [("a", 0, ""), ("a", 20, "")], [("b", 500, "")], [("b", 501, "")], [("a", 10, ""), ("b", 480, "")], [(None, 100_000, "")])
    run(SS.stream_sessions(st, "k", "t", "30 minutes", "60 minutes"), base)
    got = sorted((x.k, x.session_start, x.n_events) for x in spark.read.parquet(base + "/out").collect() if x.k)
    assert got == [("a", at(0), 2), ("b", at(480), 3)]  # the row of minute 10 came a batch after the watermark had passed it


EVENTS = [[("a", 0, "o"), ("b", 5, "o"), ("a", 30, "c")], [("b", 200, "c"), ("c", 190, "o"), ("d", 191, "x")],
          [("c", 170, "c"), ("c", 240, "c"), ("e", 230, "o"), ("e", 230, "c"), ("e", 230, "o")], [("f", 400, "o"), ("f", 460, "c")], [("z", 99_000, "x")]]


def unanswered(spark, batches):
    df = spark.createDataFrame([(k, at(m), kind) for b in batches for k, m, kind in b], "k string, t timestamp, kind string")
    u = T.unanswered(df, "k", "t", F.col("kind") == "o", F.col("kind") == "c", "60 minutes")
    return sorted((x.k, x.opened_at, x.due_at) for x in u.collect())


def test_follow_ups(spark):
    assert unanswered(spark, EVENTS) == [("b", at(5), at(65)), ("e", at(230), at(290))]


def test_follow_ups_of_a_stream_with_a_restart(spark, tmp_path):
    base = str(tmp_path)
    args = ("k", "t", F.col("kind") == "o", F.col("kind") == "c", 3600, "60 minutes")
    run(SS.stream_unanswered(fed(spark, base, *EVENTS[:2]), *args), base)
    early = spark.read.schema("k string").parquet(base + "/out").count()
    run(SS.stream_unanswered(fed(spark, base, *EVENTS[2:]), *args), base)
    got = sorted((x.k, x.opened_at, x.due_at) for x in spark.read.parquet(base + "/out").collect())
    assert got == unanswered(spark, EVENTS) and early <= 1
