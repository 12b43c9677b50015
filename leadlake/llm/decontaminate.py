"""Benchmark decontamination: Wu-Manber multi-pattern search over word windows."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.work import ascii_lower, table

WINDOW = 10            # consecutive item words that make a test string
SLICE_WINDOWS = 200_000  # test strings that are broadcast at a time; more take more passes
BLOCK = 2              # words of a block
JAVA_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")  # the same words in lower-cased UTF-8

SPANS = "doc_id long, th long, n_words long, starts array<int>, ends array<int>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    """Words of UTF-8 ``text``; ``bytes.lower`` changes A-Z only."""
    return WORD.findall(text.lower())


class WuManber:
    """Search tables for test strings (tuples of words) of one length.

    ``shift`` says how far the search may move when a block ends at the current word: no
    occurrence can end earlier. A shift of 0 means that the block ends some test string; the
    bucket of that block holds the strings to compare directly."""

    def __init__(self, strings: dict[tuple[bytes, ...], list[str]], length: int):
        self.length, self.block = length, min(BLOCK, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.buckets: dict[tuple[bytes, ...], list[tuple[tuple[bytes, ...], list[str]]]] = defaultdict(list)
        for s, items in strings.items():
            for end in range(self.block, length + 1):
                b = s[end - self.block:end]
                self.shift[b] = min(self.shift.get(b, self.far), length - end)
            self.buckets[s[length - self.block:]].append((s, items))

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of every occurrence, ascending."""
        shift, far, block, length = self.shift, self.far, self.block, self.length
        end, n = length, len(words)
        while end <= n:
            b = tuple(words[end - block:end])
            step = shift.get(b, far)
            if step:
                end += step
                continue
            for s, items in self.buckets[b]:
                if tuple(words[end - length:end]) == s:
                    yield end - length, items
            end += 1


def searchers(strings: Iterable[tuple[str, list[str]]]) -> list[WuManber]:
    """One search table per length of test string (short items are strings of their own)."""
    by_length: dict[int, dict] = defaultdict(dict)
    for joined, items in strings:
        s = tuple(joined.encode().split(b" "))
        by_length[len(s)][s] = items
    return [WuManber(x, n) for n, x in sorted(by_length.items())]


def find(words: list[bytes], tables: list[WuManber]) -> tuple[list[list[int]], set[str]]:
    """Merged spans [start, end) of the words inside occurrences, and the items that occur."""
    raw, items = [], set()
    for t in tables:
        for start, found in t.occurrences(words):
            raw.append((start, start + t.length))
            items.update(found)
    spans: list[list[int]] = []
    for a, b in sorted(raw):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    return spans, items


def test_strings(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows ``item_id string, string`` with the distinct windows of each item.

    An item of fewer than ``window`` words, but not none, is one string. Null texts and rows
    without item_id have none."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(JAVA_WORD), F.lit(0))
    b = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words.alias("w")).where(
        F.col("item_id").isNotNull() & (F.size("w") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    return b.select("item_id", F.explode(F.transform(starts, lambda i: F.array_join(
        F.slice("w", i, F.lit(window)), " "))).alias("string")).distinct()


def _search(docs: DataFrame, strings: list[tuple[str, list[str]]]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(strings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = searchers(shared.value)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "starts", "ends", "items")}
            for text in batch.column("text"):
                words = words_of(text.as_py() or b"")
                spans, items = find(words, tables)
                out["n_words"].append(len(words))
                out["starts"].append([a for a, _ in spans])
                out["ends"].append([b for _, b in spans])
                out["items"].append(sorted(items))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("th"), pa.array(out["n_words"], pa.int64()),
                 pa.array(out["starts"], pa.list_(pa.int32())), pa.array(out["ends"], pa.list_(pa.int32())),
                 pa.array(out["items"], pa.list_(pa.string()))],
                names=["doc_id", "th", "n_words", "starts", "ends", "items"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
                       F.col("text").cast("binary").alias("text")).mapInArrow(run, SPANS)


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
             slice_windows: int = SLICE_WINDOWS) -> DataFrame:
    """Rows ``doc_id, th, n_words, starts, ends, items``: where benchmark strings occur.

    The test strings are broadcast, at most about ``slice_windows`` at a time: a benchmark
    with more is dealt by item into slices, each searched in a pass of its own, and the spans
    and items of a document are merged afterwards. Documents are never shuffled for the search.

    Null text: no words. Null doc_id: searched and returned like any other row. Items with the
    same id count once. Repeated rows are each returned. An empty benchmark hits nothing."""
    strings = test_strings(benchmark, window)
    n = strings.count()
    slices = max(1, -(-n // slice_windows))
    dealt = strings.withColumn("slice", F.pmod(F.xxhash64("item_id"), F.lit(slices)))

    def one(k: int) -> DataFrame:
        rows = dealt.where(F.col("slice") == k).groupBy("string").agg(F.sort_array(F.collect_set("item_id"))).collect()
        return _search(docs, [(r[0], r[1]) for r in rows])

    found = one(0)
    if slices == 1:
        return found
    for k in range(1, slices):
        found = found.unionByName(one(k))
    merged = found.groupBy("doc_id", "th").agg(
        (F.count(F.lit(1)) / slices).cast("int").alias("n"), F.first("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_set(F.arrays_zip("starts", "ends")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # spans of different slices may overlap: cut each at the reach of those before it
    cut = F.aggregate("spans", F.struct(F.lit(0).alias("reach"), F.array().cast("array<struct<starts:int,ends:int>>").alias("done")),
                      lambda acc, s: F.struct(F.greatest(acc["reach"], s["ends"]).alias("reach"),
                                              F.when(s["ends"] > acc["reach"], F.array_append(acc["done"], F.struct(
                                                  F.greatest(acc["reach"], s["starts"]).alias("starts"), s["ends"].alias("ends"))))
                                              .otherwise(acc["done"]).alias("done")))["done"]
    return (merged.withColumn("done", cut).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
            .select("doc_id", "th", "n_words", F.col("done.starts").alias("starts"), F.col("done.ends").alias("ends"), "items"))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Rows ``doc_id, th, n_words, n_hit, items, contaminated`` (see ``overlaps``)."""
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0), lambda acc, x: acc + x)
    return overlaps(docs, benchmark, **options).select(
        "doc_id", "th", "n_words", n_hit.cast("long").alias("n_hit"), "items").withColumn(
        "contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in which no benchmark string occurs."""
    hit = contamination(docs, benchmark, **options).where("contaminated").select(
        F.col("doc_id").alias("_hit_id"), F.col("th").alias("_hit_th")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_hit_id"])
                     & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hit["_hit_th"]), "left_anti")


def op8_decontaminate(spark, sf_dir):
    """Contract digest of ``contamination`` over all documents."""
    c = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return c.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS string
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM s),
g AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS string
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
m AS (SELECT g.doc_id, g.i, g.n, s.item_id FROM g JOIN s ON g.string = s.string AND g.n = s.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
