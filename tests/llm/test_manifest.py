import hashlib
import zlib

import pytest

from leadlake.llm import manifest as mf

from . import tables


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, n_chars):
    values = (r.doc_id, r.source, r.lang, n_chars, r.text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(level):
    """All levels of the tree over the digests."""
    levels = [level]
    while len(levels[-1]) > 1:
        a = levels[-1]
        levels.append([h(*a[i:i + 2]) for i in range(0, len(a), 2)])
    return levels


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        pair = level[i // 2 * 2:i // 2 * 2 + 2]
        out.append(("-", "") if len(pair) == 1 else ("L", pair[0]) if i % 2 else ("R", pair[1]))
        i //= 2
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.lang, []).append(r)
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang, rs in by.items():
        rs.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.n_chars)))
        trees[lang] = tree([leaf_of(r, r.n_chars) for r in rs])
    top = tree([trees[x][-1][0] for x in order])
    out = []
    for k, lang in enumerate(order):
        for i, r in enumerate(by[lang]):
            path = steps(trees[lang], i) + steps(top, k)
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and r.n_chars is not None
            x = leaf_of(r, r.n_chars + 1 if hit else r.n_chars)
            for side, s in path:
                x = h(s, x) if side == "L" else h(x, s)
            out.append((r.doc_id, leaf_of(r, r.n_chars), trees[lang][-1][0], top[-1][0], h(*[s for _, s in path]), x, x == top[-1][0]))
    return sorted(out, key=repr)


def result(spark, df, monkeypatch):
    monkeypatch.setattr(mf, "table", lambda *a: df)
    return sorted([tuple(r) for r in mf.op11_manifest(spark, "").collect()], key=repr)


@pytest.mark.parametrize("slot_bits", [10, 4])
def test_given_documents(spark, sf_small, monkeypatch, slot_bits):
    monkeypatch.setattr(mf, "SLOT_BITS", slot_bits)
    df = spark.read.parquet(f"{sf_small}/documents.parquet")
    got = result(spark, df, monkeypatch)
    assert got == brute(df.collect())
    assert {r[-1] for r in got} == {True, False}


def test_awkward_rows(spark, monkeypatch):
    df = tables.awkward(spark)
    assert result(spark, df, monkeypatch) == brute(df.collect())
    assert result(spark, tables.none(spark), monkeypatch) == []


def test_scattered_and_repeated_ids_in_many_languages(spark, monkeypatch):
    big = (1 << 63) - 1
    ids = [0, 1, 1, 1, 63, 64, 64, 65, 4095, 4096, 1 << 20, 1 << 33, -1, -1, -64, -big, big, big, None, None, None]
    langs = [None, "", "en", "é", "zz"]
    rows = [(i, f"t{k % 2}", langs[(k // 2) % 5] if k < 15 else "en", "s", k % 3 or None) for k, i in enumerate(ids)]
    rows += [(5, "same", "en", None, 4)] * 40 + [(5, f"other {k}", "en", None, 4) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(mf, "SLOT_BITS", 3)
    assert result(spark, df, monkeypatch) == brute(df.collect())


def test_single_row(spark, monkeypatch):
    df = spark.createDataFrame([(3, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (r,) = result(spark, df, monkeypatch)
    assert r[1] == r[2] == r[3] and r[4] == h() and r == brute(df.collect())[0]


def test_manifest_proves_every_row(spark, sf_small):
    m = mf.merkle_manifest(spark.read.parquet(f"{sf_small}/documents.parquet"))
    r = m.select("lang", "pos", mf.folded(m["leaf"]).alias("up"), "root").collect()
    assert all(x.up == x.root for x in r) and len({(x.lang, x.pos) for x in r}) == len(r)
    assert "EvalPython" not in m._jdf.queryExecution().executedPlan().toString()
