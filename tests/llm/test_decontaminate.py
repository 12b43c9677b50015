import hashlib
import re

import pytest
from pyspark.sql import functions as F

from leadlake.llm import decontaminate as dc

from . import tables

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    strings = {}
    for i, t in items:
        w = words(t)
        if i is None or not w:
            continue
        n = min(10, len(w))
        for k in range(len(w) - n + 1):
            strings.setdefault(tuple(w[k:k + n]), set()).add(str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for s, ids in strings.items():
            for k in range(len(w) - len(s) + 1):
                if tuple(w[k:k + len(s)]) == s:
                    hit.update(range(k, k + len(s)))
                    found |= ids
        out.append((i, len(w), len(hit), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=repr)


ITEMS = [(1, tables.STORY[:400]), (2, "Part3 of, STORY5!"), (10, "word30 tells part2"), (3, None), (4, ""), (5, "!!"), (None, "a b"),
         (6, "b C d"), (6, "ünï ⚑"), (7, "long39998 long39999"), (8, "one"), (9, tables.STORY[:400])]


@pytest.mark.parametrize("slice_windows", [200_000, 8])
def test_matches_brute_force(spark, slice_windows):
    docs = [(r[0], r[1]) for r in tables.rows()]
    items = spark.createDataFrame([(*x, "c") for x in ITEMS], "item_id long, text string, slice string")
    got = dc.contamination(tables.awkward(spark), items, slice_windows=slice_windows).select(
        "doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated")
    assert sorted(tables.plain(got), key=repr) == brute(docs, ITEMS)


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert tables.plain(dc.contamination(tables.none(spark), items)) == []
    rows = dc.contamination(tables.awkward(spark), items).collect()
    assert len(rows) == len(tables.rows()) and not any(r.contaminated for r in rows)


def test_clean_documents(spark):
    items = spark.createDataFrame([(1, tables.STORY[:400])], "item_id long, text string")
    kept = dc.clean_documents(tables.awkward(spark), items)
    assert kept.columns == tables.awkward(spark).columns
    assert kept.count() == len(tables.rows()) - 3


def test_shift_tables_never_skip_an_occurrence():
    import random
    r = random.Random(5)
    for _ in range(300):
        n = r.randrange(1, 6)
        strings = {tuple(r.choice([b"a", b"b", b"c"]) for _ in range(n)): ["x"] for _ in range(r.randrange(1, 5))}
        text = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        got = [s for s, _ in dc.WuManber(strings, n).occurrences(text)]
        assert got == [k for k in range(len(text) - n + 1) if tuple(text[k:k + n]) in strings]


def test_query_digest(spark, tmp_path):
    tables.awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.n_hit, r.n_items, r.items_sha256) for r in dc.op8_decontaminate(spark, str(tmp_path)).collect()}
    assert got == {(i, n, len([x for x in s.split(",") if x]), hashlib.sha256(s.encode()).hexdigest())
                   for i, _, n, s, _ in brute([(r[0], r[1]) for r in tables.rows()], ITEMS)}
