import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from leadlake.llm import simhash as sh

from . import tables


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(x) for x in range(n)]


def parts_of(fps, links=None, distance=4):
    """The components as a set of sets of fingerprints: of all near pairs, or of the links given."""
    fps = [int(x) for x in fps]
    if links is None:
        a = np.array(fps, np.uint64)
        pairs = list(zip(*np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= distance, 1))))
    else:
        at = {x: k for k, x in enumerate(fps)}
        pairs = [(at[int(x)], at[int(y)]) for x, y in links]
    groups = {}
    for x, r in zip(fps, roots(len(fps), pairs)):
        groups.setdefault(r, set()).add(x)
    return set(map(frozenset, groups.values()))


def cloud(n, seed, groups=6, flips=5):
    """Random fingerprints, some of them in clouds of near ones."""
    r = np.random.default_rng(seed)
    out = set(r.integers(0, 1 << 63, n // 2).astype(np.uint64).tolist())
    for c in r.integers(0, 1 << 63, groups).astype(np.uint64).tolist():
        for _ in range(n // 2 // groups):
            for b in r.integers(0, 64, r.integers(0, flips + 1)).tolist():
                c_ = c ^ (1 << b)
                out.add(c_)
                c = c_ if r.random() < 0.1 else c
    return np.array(sorted(out), np.uint64)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbB éÉ\t\n\x0b \x1c", max_size=60))
def test_fingerprint(text):
    assert sh.fingerprint(text.encode()) == print_of(text)


def test_long_text():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert sh.fingerprint(text.encode()) == print_of(text)


@pytest.mark.parametrize("flips", [2, 6])
def test_forest_connects_what_all_pairs_connect(flips):
    fps = cloud(500, flips, flips=flips)
    links = sh.forest(fps)
    assert parts_of(fps, links) == parts_of(fps) and len(links) < len(fps)
    cut = len(fps) // 2
    both = np.concatenate([sh.forest(fps[:cut]), sh.forest(fps[cut:]), sh.forest(fps[:cut], fps[cut:])])
    assert parts_of(fps, both) == parts_of(fps)


@pytest.mark.parametrize("bits,radius", [*sh.thirds(4), (sh._ALL, 4)])
def test_linked_fingerprints_meet(bits, radius, monkeypatch):
    monkeypatch.setattr(sh, "SHARD", 30)
    fps = cloud(2000, 7)
    trees = sh.Trees(1)
    root = trees.grow(fps, 1.0, bits, radius, np.random.default_rng(0))
    assert trees.next > 8
    at = [set() for _ in fps]
    for shard, i in trees.route(root, fps):
        for x in i:
            at[x].add(shard)
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]) & np.uint64(bits)) <= radius
    assert all(at[a] & at[b] for a, b in zip(*np.nonzero(near)))
    assert sum(map(len, at)) < len(fps) * trees.next / 3


@pytest.mark.parametrize("shard,limit,rounds", [(1024, 4096, 8), (40, 60, 8), (40, 60, 1), (100, 30, 2)])
def test_links_of_all_shards(spark, monkeypatch, shard, limit, rounds):
    monkeypatch.setattr(sh, "SHARD", shard)
    monkeypatch.setattr(sh, "LIMIT", limit)
    monkeypatch.setattr(sh, "ROUNDS", rounds)
    fps = cloud(1500, 11)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    links = sh.near_links(df).collect()
    assert parts_of(fps.view(np.int64), [(r.a, r.b) for r in links]) == {frozenset(int(x) for x in np.array(list(g), np.uint64).view(np.int64)) for g in parts_of(fps)}


def brute(rows):
    prints = [print_of(t) for _, t in rows]
    uniq = sorted(set(prints))
    least = {}
    for group in parts_of(uniq):
        ids = [i for (i, _), p in zip(rows, prints) if p in group and i is not None]
        least.update({p: min(ids, default=None) for p in group})
    return sorted([(i, f"{p:016x}", least[p]) for (i, _), p in zip(rows, prints)], key=repr)


def test_small_tables(spark, sf_small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    assert sorted(map(tuple, sh.op13_simhash(spark, sf_small).collect()), key=repr) == brute(rows)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(sh, "table", lambda *a: tables.awkward(spark))
    want = brute([r[:2] for r in tables.rows()])
    assert sorted(map(tuple, sh.op13_simhash(spark, "").collect()), key=repr) == want
    assert tables.plain(sh.near_duplicates(tables.none(spark))) == []
