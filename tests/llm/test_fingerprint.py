import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from leadlake.llm import fingerprint as fp

from . import tables


def test_likeness_is_exact():
    r = np.random.default_rng(0)
    a, b = [], []
    for _ in range(200):
        u = r.integers(0, 2**63, 400).astype(np.uint64)
        a.append(u[:r.integers(0, 200)])
        b.append(np.concatenate([a[-1][:r.integers(0, 100)], u[200:200 + r.integers(0, 200)]]))
    want = [len(set(x.tolist()) & set(y.tolist())) / len(set(x.tolist()) | set(y.tolist())) if len(x) + len(y) else 1.0
            for x, y in zip(a, b)]
    assert np.allclose(fp.likeness(a, b), want)


def test_equal_digests_in_one_version_end():
    five = np.array([5], np.uint64)
    assert np.allclose(fp.likeness([np.repeat(five, 3)], [five]), [1 / 3])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "aa", "n n", "f.", " "]), max_size=60))
def test_digests_tell_copies_apart(pieces):
    d = fp.digests("\n".join(pieces).encode())
    assert len(set(d.tolist())) == len(d)


def brute(rows):
    """Rows in descending order of id, null ids last; ties are left to the operator."""
    out = []
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        out.append((i, len(t), hashlib.sha256((t[:len(t) - h] + after[:h]).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_small_tables(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").orderBy("doc_id", ascending=False).collect()]
    got = fp.op10_fingerprint(spark, sf_small).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == brute(rows)
    text, prints = dict(rows), {}
    for r in got:
        assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert len(set(prints.values())) == len(prints)
    assert np.mean([r.near_edited > r.near_next for r in got]) > 0.9


def test_awkward_rows(spark):
    seen, rows = set(), []
    for i, t, *_ in tables.rows():  # one row for each id: the order of ties is the operator's own
        if i not in seen:
            seen.add(i)
            rows.append((i, t, "clash"))
    df = spark.createDataFrame(rows, "doc_id long, text string, tail string")
    ordered = sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)
    got = fp.fingerprint_documents(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=repr) == brute([r[:2] for r in ordered])
    assert len(fp.fingerprint_documents(tables.awkward(spark)).collect()) == len(tables.rows())
    assert tables.plain(fp.fingerprint_documents(tables.none(spark))) == []


def test_single_document_follows_itself(spark):
    r = fp.fingerprint_documents(spark.createDataFrame([(1, "abcde")], "doc_id long, text string")).collect()
    assert r[0].edited_sha256 == hashlib.sha256(b"abcab").hexdigest() and r[0].near_next == 1.0
