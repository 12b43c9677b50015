import hashlib
from collections import defaultdict

from leadlake.llm.line_dedup import drop_repeated_lines, op1_line_dedup

from . import tables

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """Per row (doc_id, lines, dropped, text)."""
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_matches_brute_force_on_awkward_rows(spark):
    extra = [(20, tables.SHARED + "\n" + tables.SHARED.lower() + "\nend")]
    df = tables.awkward(spark).select("doc_id", "text", "line", "th").union(
        spark.createDataFrame([(*extra[0], "c", "c")], "doc_id long, text string, line string, th string"))
    got = drop_repeated_lines(df).select("doc_id", "n_lines", "n_dropped", "text")
    want = brute([(r[0], r[1]) for r in tables.rows()] + extra)
    assert sorted(tables.plain(got), key=repr) == sorted(want, key=repr)
    assert any(w[2] for w in want)


def test_no_rows(spark):
    assert tables.plain(drop_repeated_lines(tables.none(spark))) == []


def test_query_hashes_the_kept_text(spark, tmp_path):
    tables.awkward(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in op1_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute([(r[0], r[1]) for r in tables.rows()])}
