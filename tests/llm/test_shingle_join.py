import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadlake.llm import shingle_join as sj
from leadlake.llm.components import components

from . import tables


def sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in w.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=75):
    """{row position: (doc_id, size, component)}; rows with one id are one node."""
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        same_id = rows[a][0] is not None and rows[a][0] == rows[b][0]
        if same_id or (s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b])):
            parent[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if root(m) == root(k) and rows[m][0] is not None]
        out.append((i, len(s[k]), (min(ids) if ids else None) if s[k] else i))
    return sorted(out, key=repr)


def near_copies(n, seed):
    r = random.Random(seed)
    base = [[f"w{r.randrange(4000)}" for _ in range(r.randrange(3, 120))] for _ in range(max(1, n // 8))]
    rows = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(len(words))] = f"e{r.randrange(9999)}"
        if r.random() < 0.2:
            words = words[:r.randrange(1, len(words) + 1)]
        if r.random() < 0.3:
            words += base[0][:30]
        rows.append((i, " ".join(words)))
    return rows


@pytest.mark.parametrize("small", [sj.SMALL_BUCKET, 1])
def test_near_copies_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(sj, "SMALL_BUCKET", small)
    rows = near_copies(250, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tables.plain(sj.shingle_components(df)), key=repr) == brute(rows)


@pytest.mark.parametrize("percent", [sj.LEAST_PERCENT, 90])
def test_other_similarities_match_brute_force(spark, monkeypatch, percent):
    monkeypatch.setattr(sj, "SMALL_BUCKET", 2)
    rows = near_copies(120, percent) + [(1000, "a b"), (1001, "a b c"), (1002, "a b c d e"), (1003, "a b c d e f"), (1004, "a b c d e f g"), (1005, "b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tables.plain(sj.shingle_components(df, percent=percent)), key=repr) == brute(rows, percent)


@pytest.mark.parametrize("percent", [0, 50, 66, 101])
def test_similarities_without_signatures_raise(spark, percent):
    with pytest.raises(ValueError):
        sj.shingle_components(tables.none(spark), percent=percent)


def test_the_second_pass_matches_odd_rows_only(spark):
    r = random.Random(6)
    # one cluster of 20,000 rows under an unrelated pivot, and a few rows of other clusters
    rows = [(k, 7, 100, 90, 1) for k in range(20_000)] + [(30_000 + k, 7, 100, r.randrange(60, 100), 2 + k % 3) for k in range(6)]
    df = spark.createDataFrame(rows, "rep long, pivot long, n long, covered long, label long")
    odd, every = sj._apart(df, "pivot")
    assert odd.count() == 6 and every.count() == len(rows)
    assert sj._apart(df.where("label = 1"), "pivot")[1].count() == 0
    few = spark.createDataFrame(rows[:40] + rows[-6:], df.schema)
    want = {(a[0], b[0]) for a, b in combinations(rows[:40] + rows[-6:], 2) if a[4] != b[4] and 100 * min(a[3], b[3]) >= 75 * (200 - min(a[3], b[3]))}
    assert {tuple(x) for x in sj._covered(few, 75).collect()} == want
    keyed = few.selectExpr("rep", "pivot AS key", "n AS least", "n AS most", "label")
    assert {tuple(x) for x in sj._odd_pairs(keyed, 75).collect()} == {(a[0], b[0]) for a, b in combinations(rows[:40] + rows[-6:], 2) if a[4] != b[4]}


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in tables.rows()]
    assert sorted(tables.plain(sj.shingle_components(tables.awkward(spark))), key=repr) == brute(rows)
    assert tables.plain(sj.shingle_components(tables.none(spark))) == []


def test_one_of_each_keeps_columns_and_clean_rows(spark):
    kept = sj.one_of_each(tables.awkward(spark))
    assert kept.columns == tables.awkward(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and 7 in ids and 4 in ids


def linked_sets(r, universe):
    n = r.randrange(3, 90)
    a = set(r.sample(universe, n))
    b = set(a)
    for x in r.sample(sorted(a), r.randrange(0, n // 4 + 1)):
        b.discard(x)
    while r.random() < 0.8:
        b.add(r.choice(universe))
    return a, b


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([0.0, 0.3, 0.7, 0.95, 1.0]))
def test_linked_sets_share_a_signature(seed, share):
    """Whatever tokens are of the frequent class."""
    r = random.Random(seed)
    universe = [r.getrandbits(64) for _ in range(160)]
    frequent = np.zeros(1 << (sj.CLASS_BITS - 3), np.uint8)
    for u in universe:
        if r.random() < share:
            slot = u >> (64 - sj.CLASS_BITS)
            frequent[slot >> 3] |= 1 << (slot & 7)
    a, b = (np.array(sorted(x), np.uint64) for x in linked_sets(r, universe))
    if sj.linked(a, b):
        assert set(sj.signatures(a, frequent).tolist()) & set(sj.signatures(b, frequent).tolist())
        assert sj.may_link(len(a), len(b), sj.bitmap(a), sj.bitmap(b))


def test_signatures_of_frequent_tokens_stay_about_as_many_as_tokens():
    every = np.full(1 << (sj.CLASS_BITS - 3), 255, np.uint8)
    for n in (10, 100, 1000, 20_000):
        tokens = np.unique(np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64))
        assert len(sj.signatures(tokens, every)) < 4 * n


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_linked_sets_of_a_bucket_share_a_residue_or_enough_of_the_pivot(seed):
    r = random.Random(seed)
    universe = [r.getrandbits(64) for _ in range(160)]
    none = np.zeros(1 << (sj.CLASS_BITS - 3), np.uint8)
    a, b = (np.array(sorted(x), np.uint64) for x in linked_sets(r, universe))
    center = np.array(sorted(set(r.sample(universe, r.randrange(1, 60))) | set(r.sample(sorted(a.tolist()), r.randrange(0, len(a))))), np.uint64)
    if sj.linked(a, b):
        (ca, ka), (cb, kb) = (sj.residue(x, none, 7, center) for x in (a, b))
        most = min(ca, cb)
        assert 100 * most >= sj.PERCENT * (len(a) + len(b) - most) or set(ka.tolist()) & set(kb.tolist())


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}


def test_frequent_class_counts_every_text_once(spark):
    """A shingle in ``FREQUENT`` classes of texts is of the class wherever these texts fall, copies of one text make none."""
    from pyspark.sql import functions as F
    texts = [f"a b c d e x{i}" for i in range(4000)]
    hashed = [(r.text, r.th) for r in spark.createDataFrame([(t,) for t in texts], "text string")
              .select("text", F.xxhash64("text").alias("th")).collect()]
    late = [(t, h) for t, h in hashed if h > 0]  # the upper half of all hashes
    one_of_class = list({h & 63: t for t, h in late}.values())[:sj.FREQUENT]
    assert len(one_of_class) == sj.FREQUENT
    copies = ["p q r s t"] * 500
    rows = list(enumerate([*one_of_class, *copies]))

    def often(texts, shingle):
        table = sj._frequent(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sj.WORDS)
        return len(sj.by_class(sj.shingles(shingle), table)[1]) == 1

    assert often([t for _, t in rows], b"a b c d e")
    assert not often([t for _, t in rows], b"p q r s t")
    assert not often(one_of_class[1:], b"a b c d e")


@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 2**64 - 1)), max_size=60))
def test_distinct_values_ascend(values):
    assert sj._distinct(np.array(values, np.uint64)).tolist() == sorted(set(values))


def test_rows_go_to_python_in_small_batches(spark, monkeypatch):
    """Whatever is made by Python functions; the setting is as before afterwards."""
    from leadlake.llm import work
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, saved = spark.conf.get(key), {}, work.saved
    monkeypatch.setattr(sj, "saved", lambda df, name: seen.update({name: spark.conf.get(key)}) or saved(df, name))
    monkeypatch.setattr(sj, "SMALL_BUCKET", 1)
    rows = near_copies(60, 5)
    sj.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {seen[k] for k in ("frequent-class", "shingle-index", "possible-links", "links", "residues")} == {str(8 << 20)}
    assert spark.conf.get(key) == before


def test_occurrences_are_sent_by_pieces_in_order(spark, monkeypatch):
    from pyspark.sql import functions as F
    texts = [f"a b c d e x{i} y{i % 7} z" for i in range(300)] + ["", None, "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {(int(s) >> 6, r.th & 63) for r in sj._texts(df).select("th", F.col("text").cast("binary").alias("text")).collect()
            for s in sj.shingles(bytes(r.text))}
    monkeypatch.setattr(sj, "MARKS", 200)
    got = set()
    for r in sj._occurrences(df, sj.WORDS).collect():
        marks = np.frombuffer(bytes(r.marks), np.uint64).tolist()
        assert marks and marks == sorted(set(marks)) and {m >> (64 - sj.PIECE_BITS) for m in marks} == {r.piece}
        got |= {(m >> 6, m & 63) for m in marks}
    assert got == want
