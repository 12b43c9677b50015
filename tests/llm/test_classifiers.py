import math
import re
import zlib

import numpy as np
import pytest

from leadlake.llm import quality, toxicity

from . import tables


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable")
    pos = y == 1
    return (order[pos].sum() - pos.sum() * (pos.sum() - 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def tables_dir():
    return "/root/testdata/sf0.1"


def held_out_rows(spark, df, label, sf_dir):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in df.where("held_out").collect() if r.doc_id in labels]
    return np.array([labels[r.doc_id] for r in rows]), np.array([r.score for r in rows]), np.array([r.predicted for r in rows])


def test_quality_on_held_out_rows(spark, tables_dir):
    y, s, p = held_out_rows(spark, quality.op6_quality(spark, tables_dir), "quality", tables_dir)
    assert len(y) > 1000 and auc(y, s) > 0.99 and (p == y).mean() > 0.98


def test_toxicity_on_held_out_rows(spark, tables_dir):
    y, s, p = held_out_rows(spark, toxicity.op2_toxicity(spark, tables_dir), "toxic", tables_dir)
    assert len(y) > 700 and auc(y, s) > 0.95 and p[y == 0].mean() < 0.01 and p[y == 1].mean() > 0.85


@pytest.mark.parametrize("score, folds, fold", [(quality.score_quality, 3, 1), (toxicity.score_toxicity, 5, 0)])
def test_awkward_rows(spark, score, folds, fold):
    docs = tables.awkward(spark)
    some = tables.labels(spark, [(i, i % 2, int(i % 3 == 0), "t", "l") for i in range(1, 18)] + [(1, None, None, "t", "l"), (None, 1, 1, "t", "l"), (2, 0, 0, "t", "l"), (2, 0, 0, "t", "l")])
    for labels in (some, tables.labels(spark), tables.labels(spark, [(1, 1, 1, "t", "l")])):
        rows = score(docs, labels).collect()
        assert len(rows) == len(tables.rows())
        assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
        for r in rows:
            assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == fold)
        texts = {}
        for i, t, *_ in tables.rows():
            texts.setdefault(i, t)
        by = {r.doc_id: r.score for r in rows}
        assert by[4] == by[5]  # null and empty
    assert tables.plain(score(tables.none(spark), some)) == []


def test_held_out_labels_are_never_read(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F
    out = quality.held_out(5, 0)
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, x).collect()) for x in (labels, turned))
    assert a == b
    out = quality.held_out(3, 1)
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (np.array([r.score for r in quality.score_quality(docs, x).orderBy("doc_id").collect()]) for x in (labels, turned))
    assert np.allclose(a, b)


def test_best_cut_against_all_cuts():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 30, 200):
        m, y = r.normal(size=n).round(1), (r.random(n) < 0.3).astype(float)
        errors = lambda c: int(np.sum((m >= c) != (y > 0)))
        u = np.unique(m)
        cuts = [0.0, *((u[:-1] + u[1:]) / 2)]
        least = min(map(errors, cuts))
        cut = toxicity.best_cut(m, y)
        assert errors(cut) == least and abs(cut) <= min(abs(c) for c in cuts if errors(c) == least) + 1e-12
    assert toxicity.best_cut(np.zeros(0), np.zeros(0)) == 0.0


def test_fits_in_tasks_equal_plain_fits(spark):
    """The bias moves by the best cut of the margins that machines of the other rows give; all else is the fit of all rows."""
    r = np.random.default_rng(6)
    cols = [np.unique(r.integers(0, 60, 12)).astype(np.int32) for _ in range(150)]
    y = np.array([float(3 in c) for c in cols])
    cols += cols[:20]  # equal rows are in one part
    y = np.append(y, y[:20])
    part = [zlib.crc32(c.tobytes()) % 3 for c in cols]
    margins = np.zeros(len(cols))
    for k in range(3):
        m = toxicity.fit([c for c, p in zip(cols, part) if p != k], np.array([v for v, p in zip(y, part) if p != k]), steps_pairs=20)
        for i, p in enumerate(part):
            if p == k:
                margins[i] = m.margins([cols[i]])[0]
    whole = toxicity.fit(cols, y, steps_pairs=20)
    got = toxicity._fit_in_tasks(spark, [c.tobytes() for c in cols], y, 3, {"steps_pairs": 20})
    assert np.allclose(got.w, whole.w) and np.allclose(got.v, whole.v) and got.active.tolist() == whole.active.tolist()
    assert abs(got.bias - (whole.bias - toxicity.best_cut(margins, y))) < 1e-9


def test_toxicity_scores_equal_a_plain_sum_over_pairs(spark, sf_small):
    """Every document's score from the weights of a fit of its own, pair by pair."""
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    m = toxicity.train(docs, labels)
    place = {int(c): i for i, c in enumerate(m.active)}
    got = {r.doc_id: (r.score, r.predicted, r.held_out) for r in toxicity.op2_toxicity(spark, sf_small).collect()}
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = {w.encode() for w in re.findall(r"[0-9a-z\u0080-\U0010ffff]+", lower)}
        terms = words | {b"^" + w[:6] for w in words if len(w) > 6}
        at = sorted({place[c] for c in (zlib.crc32(t) % 2 ** 18 for t in terms) if c in place})
        pairs = np.triu(m.v[at] @ m.v[at].T, 1).sum() if at else 0.0
        want = 1 / (1 + math.exp(-(m.bias + sum(m.w[a] for a in at) + pairs)))
        assert abs(got[i][0] - want) < 1e-6 and got[i][1] == int(got[i][0] >= 0.5), i
        assert got[i][2] == (zlib.crc32(str(i).encode()) % 5 == 0)


def plain_statistics(text):
    """The twelve statistics, character by character."""
    t = text or ""
    words, lines = [w for w in re.split("[ \t-\r]+", t) if w], [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")]
    share = lambda f, of: math.sqrt(sum(map(f, t)) / max(1, of))
    among = lambda chars: lambda c: c in chars
    upper, lower, digit = (lambda a, b: lambda c: a <= c <= b)("A", "Z"), (lambda c: "a" <= c <= "z"), (lambda c: "0" <= c <= "9")
    kinds = [upper, lower, digit, lambda c: c > "\x7f", among(".,;:"), among("!?"), among("#$%&*+/<=>@\\^_`{|}~[]"), among(" \t\n\v\f\r")]
    n = len(t)
    return [math.log1p(len(words)), math.log1p(max(1, n) / max(1, len(words))), share(upper, sum(map(upper, t)) + sum(map(lower, t))),
            share(digit, n), share(kinds[3], n), share(kinds[4], n), share(kinds[5], n), share(kinds[6], n),
            share(lambda c: not any(k(c) for k in kinds), n) if n else 1.0, len(set(words)) / max(1, len(words)),
            1 - len(set(lines)) / max(1, len(lines)), math.log1p(max(1, len(words)) / max(1, len(lines)))]


def test_quality_scores_equal_plain_densities(spark, sf_small):
    """Every document's score from plain statistics, class covariances by numpy and the densities themselves."""
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    x = {r.doc_id: plain_statistics(r.text) for r in docs.select("doc_id", "text").collect()}
    out = {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in x}
    learnt = [(x[r.doc_id], r.quality) for r in labels.collect() if r.doc_id in x and not out[r.doc_id] and r.quality in (0, 1)]
    own = [np.array([v for v, c in learnt if c == k]) for k in (0, 1)]
    cov, n = [np.cov(v.T, bias=True) for v in own], [len(v) for v in own]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / sum(n)
    cov = [0.9 * c + 0.1 * pooled + 1e-3 * np.trace(pooled) / len(pooled) * np.eye(len(pooled)) for c in cov]

    def log_density(v, k):
        d = v - own[k].mean(axis=0)
        return math.log(n[k] / sum(n)) - 0.5 * np.linalg.slogdet(cov[k])[1] - 0.5 * d @ np.linalg.solve(cov[k], d)

    rows = quality.op6_quality(spark, sf_small).collect()
    assert sorted(r.doc_id for r in rows) == sorted(x)
    for r in rows:
        v = np.array(x[r.doc_id])
        want = 1 / (1 + math.exp(min(500, max(-500, log_density(v, 0) - log_density(v, 1)))))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.5) and r.held_out == out[r.doc_id], r.doc_id


def test_pairwise_term_is_the_sum_over_pairs():
    r = np.random.default_rng(1)
    m = toxicity.Machine(0.3, np.arange(0, 40, 2), r.normal(size=20), r.normal(size=(20, 3)))
    row = np.unique(r.integers(0, 50, 15))
    known = [int(c) // 2 for c in row if c < 40 and c % 2 == 0]
    want = 0.3 + sum(m.w[k] for k in known) + sum(m.v[a] @ m.v[b] for x, a in enumerate(known) for b in known[x + 1:])
    assert abs(m.margins([row])[0] - want) < 1e-9


def test_factorization_machine_learns_a_pair_that_weights_miss():
    """Term 1 with term 2 is positive, either alone is not more so than their absence."""
    r = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(1200):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(np.array(sorted({10} | ({1} if a else set()) | ({2} if b else set()))))
        y.append(float(a == b))
    m = toxicity.fit(rows, np.array(y), l1=0.0, steps_pairs=400)
    assert ((m.score(rows) >= 0.5) == np.array(y)).mean() > 0.95


def test_factorization_machine_learns_a_pair_by_default():
    """Under the production defaults, where the additive fit leaves both terms at zero."""
    r = np.random.default_rng(2)
    rows, y = [], []
    for _ in range(1200):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(np.array(sorted({10} | ({1} if a else set()) | ({2} if b else set()))))
        y.append(float(a == b))
    m = toxicity.fit(rows, np.array(y))
    assert ((m.score(rows) >= 0.5) == np.array(y)).mean() > 0.95


def test_every_term_of_two_rows_has_a_vector():
    m = toxicity.fit([np.array([1, 2, 3]), np.array([1, 2]), np.array([1]), np.array([1, 4])], np.array([1.0, 0.0, 0.0, 0.0]))
    assert m.active.tolist() == [1, 2] and np.all(np.abs(m.v).max(axis=1) > 0)


def test_discriminant_equals_the_normal_densities():
    r = np.random.default_rng(3)
    x = {c: r.multivariate_normal([c, 2 * c], [[1 + c, 0.3], [0.3, 1]], 4000) for c in (0, 1)}
    model = quality.fit({c: (len(v), v.sum(axis=0), v.T @ v) for c, v in x.items()}, shrink=0.0, ridge=0.0)
    at = r.normal(size=(50, 2))

    def log_density(v):
        mean, cov = v.mean(axis=0), np.cov(v.T, bias=True)
        d = at - mean
        return -0.5 * np.log(np.linalg.det(cov)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)

    want = 1 / (1 + np.exp(log_density(x[0]) - log_density(x[1])))
    assert np.allclose(model.score(at), want)


def test_good_documents_keeps_columns(spark, sf_small):
    docs, labels = (spark.read.parquet(f"{sf_small}/{t}.parquet") for t in ("documents", "labels"))
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns
    good = {r.doc_id for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in kept.collect()} == good
