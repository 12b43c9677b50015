import math
from fractions import Fraction

import numpy as np

from leadlake.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, n string, i string, whitened string"


def frame(spark, vectors):
    return spark.createDataFrame([(k, v, "clash", "clash", "clash") for k, v in enumerate(vectors)], SCHEMA)


def exact(vectors):
    """x, sums and covariance in Python's own integers and fractions."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    cov = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n ** 3)) for j in range(d)] for i in range(d)])
    return x, s, cov


def check(got, vectors, ids, k=8):
    x, s, cov = exact(vectors)
    n = len(x)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    got = {r.vec_id: r for r in got}
    assert sorted(got) == sorted(ids)
    mean = np.array([v / n for v in s])
    white = np.array([got[i].whitened for i in ids])
    for i, row in zip(ids, x):
        assert got[i].n == n and got[i].deviation == sum((n * a - b) ** 2 for a, b in zip(row, s))
        assert np.allclose(got[i].explained, values[:k] / np.trace(cov), rtol=1e-9)
        assert got[i].identity_error < 1e-9
    want = (np.array(x) - mean) @ axes[:, :k] / np.sqrt(values[:k])
    for c in range(k):
        sign = np.sign((white[:, c] * want[:, c]).sum())
        assert np.abs(white[:, c] - sign * want[:, c]).max() < 1e-7


def test_given_vectors(spark, sf_small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()][:300]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    check(wh.whiten(df).collect(), [v for _, v in rows], [i for i, _ in rows])


def test_query_counts_every_usable_row(spark, sf_small):
    got = wh.op12_whitening(spark, sf_small)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    total = spark.read.parquet(f"{sf_small}/embeddings.parquet").count()
    assert got.count() == 8 * total and got.where("n <> %d" % total).count() == 0
    assert {r.component for r in got.select("component").distinct().collect()} == set(range(1, 9))


def test_bad_rows_go(spark):
    r = np.random.default_rng(1)
    good = r.normal(size=(40, 10)).tolist()
    bad = [None, [None] + [0.0] * 9, [float("nan")] * 10, [float("inf")] + [1.0] * 9, [1.0] * 9, [], [3e38] * 10]
    rows = good[:20] + bad + good[20:]
    df = frame(spark, rows)
    keep = [k for k, v in enumerate(rows) if k < 20 or k >= 20 + len(bad)]
    check(wh.whiten(df).collect(), good, keep)


def test_large_entries_stay_exact(spark):
    r = np.random.default_rng(2)
    vectors = (r.normal(size=(30, 9)) * 10.0 ** r.integers(0, 7, (30, 9))).tolist()
    got = wh.whiten(frame(spark, vectors)).collect()
    x, s, cov = exact(vectors)
    for g in got:
        want = sum((30 * a - b) ** 2 for a, b in zip(x[g.vec_id], s))
        assert g.deviation == (want if want < 1 << 63 else None)
        assert np.allclose(g.explained, np.linalg.eigvalsh(cov)[::-1][:8] / np.trace(cov), rtol=1e-7)
    assert any(g.deviation is None for g in got)


def test_rank_and_ties(spark):
    base = [[1.0, 2.0, 3.0, 0.0], [2.0, 4.0, 6.0, 0.0], [3.0, 6.0, 9.0, 0.0], [1.0, 2.0, 3.0, 0.0]]
    got = wh.whiten(frame(spark, base)).collect()
    assert all(len(g.whitened) == 1 and abs(g.explained[0] - 1) < 1e-9 and g.identity_error < 1e-9 for g in got)
    at = {g.vec_id: g.whitened for g in got}
    assert at[0] == at[3] and at[0] != at[1]
    same = wh.whiten(frame(spark, [[1.0, 2.0]] * 5)).collect()
    assert len(same) == 5 and all(g.whitened == [] and g.deviation == 0 for g in same)
    assert len(wh.whiten(frame(spark, [[], []])).collect()) == 2
    assert wh.whiten(frame(spark, [[1.0]]).limit(0)).collect() == []
    assert wh.whiten(frame(spark, [None, [None]])).collect() == []


def test_factors():
    r = np.random.default_rng(3)
    for d, rank in ((1, 1), (2, 2), (7, 3), (64, 64), (33, 20)):
        b = r.normal(size=(d, rank)) * 10.0 ** r.integers(-3, 3, rank)
        a = b @ b.T
        f = wh.pivoted_cholesky(a)
        assert np.allclose(f @ f.T, a, rtol=1e-9, atol=1e-9 * a.max())
        values, axes = wh.one_sided_jacobi(f)
        assert np.allclose(axes.T @ axes, np.eye(len(values)), atol=1e-10)
        assert np.allclose((axes * values) @ axes.T, a, rtol=1e-8, atol=1e-9 * a.max())
