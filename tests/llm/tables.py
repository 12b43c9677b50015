"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, and
extra columns whose names the operators use inside."""

from __future__ import annotations

CLASHES = ("th", "th2", "key", "line", "pos", "rep", "label", "score", "tail", "next", "draw", "bucket", "src", "size",
           "x", "w", "items", "host", "wrapper", "found", "node", "_mix_id", "_gone_id", "_hit_id", "_bad_id", "_id")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)

SHARED = "This very line of more than forty characters is shared by many documents."
STORY = " ".join(f"word{i} tells part{i % 7} of story{i % 11}" for i in range(60))
EDITED = STORY.replace("word30", "edit30")
LONG = " ".join(f"long{i}" for i in range(40_000)) + "\n" + SHARED


def rows() -> list[tuple]:
    texts = [
        (1, STORY), (2, EDITED), (3, STORY), (4, None), (5, ""), (6, " \t\r\n\x0b "), (7, LONG), (8, "One two THREE"),
        (9, "one  two\tthree"), (10, SHARED + "\nalone"), (11, "  " + SHARED.upper() + "\nx\n"), (12, SHARED), (13, SHARED),
        (14, "é ünï ⚑ 日本語 " * 20), (15, "x\n\n\ny"), (16, "a b c d e f g"), (16, "a b c d e f g"), (17, "b c d e f g a"),
        (None, "a row without an id " + SHARED), (None, SHARED), (None, None), (18, "z" * 300_000),
    ]
    sources = ["a", "b", None, "c"]
    return [(i, t, "en", sources[k % 4], len(t or ""), *["clash"] * len(CLASHES)) for k, (i, t) in enumerate(texts)]


def awkward(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, text string, label string")


def plain(df):
    return [tuple(r) for r in df.collect()]
