"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadlake.llm.work import parts, table

HASHES = 3     # cells that a digest goes to, one in each third of a sketch
CELLS = 8      # cells of each third of a fingerprint
GROW = 4       # a sketch that can't be peeled is built again this much larger
ROWS = 256     # documents whose sketches are built and peeled together

# A paragraph is a line; within it a piece ends after a word whose last byte is 6 modulo 8 (as
# n, f, v and the full stop), so that an edit changes the pieces it touches and no others.
_CUT = re.compile(rb"\n+|(?<=[&.6>FNV^fnv~])[ \t]+")


def digests(text: bytes | None) -> np.ndarray:
    """64-bit digests of the pieces of a text; the k-th copy of a piece has a digest of its own."""
    seen: dict[bytes, int] = {}
    out = []
    for piece in _CUT.split(text or b""):
        piece = piece.strip()
        if piece:
            k = seen.get(piece, 0)
            seen[piece] = k + 1
            out.append(xxhash.xxh3_64_intdigest(piece + b"\n%d" % k if k else piece))
    return np.array(out, np.uint64)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _check(keys: np.ndarray) -> np.ndarray:
    return _mix(keys, 99) & np.uint64(0xFFFFFFFF)


class Sketches:
    """One sketch per row: counts, sums of digests and sums of check hashes (modulo 2^64)."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        size = n * HASHES * cells
        self.count, self.key, self.check = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)

    def add(self, row: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> None:
        check, up = _check(keys), sign > 0
        keys_, check_ = np.where(up, keys, np.uint64(0) - keys), np.where(up, check, np.uint64(0) - check)
        for j in range(HASHES):
            at = (row * HASHES + j) * self.cells + (_mix(keys, j + 1) % np.uint64(self.cells)).astype(np.int64)
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, keys_)
            np.add.at(self.check, at, check_)

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Take out digests that are alone in a cell until none is. For each row whether all came
        out, the number of digests of the first version only, and of the second only."""
        width = HASHES * self.cells
        plus, minus = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        look = np.arange(len(self.count))
        while len(look):
            c = self.count[look]
            look = look[np.abs(c) == 1]
            sign = self.count[look]
            keys = np.where(sign > 0, self.key[look], np.uint64(0) - self.key[look])
            pure = _check(keys) == np.where(sign > 0, self.check[look], np.uint64(0) - self.check[look])
            look, sign, keys = look[pure], sign[pure], keys[pure]
            row = look // width
            _, first = np.unique(keys + _mix(row.astype(np.uint64), 50), return_index=True)  # alone in several cells
            row, keys, sign = row[first], keys[first], sign[first]
            plus += np.bincount(row[sign > 0], minlength=self.n)
            minus += np.bincount(row[sign < 0], minlength=self.n)
            self.add(row, keys, -sign)
            look = np.concatenate([
                (row * HASHES + j) * self.cells + (_mix(keys, j + 1) % np.uint64(self.cells)).astype(np.int64)
                for j in range(HASHES)])
        whole = (self.count == 0) & (self.key == 0) & (self.check == 0)
        return whole.reshape(self.n, width).all(axis=1), plus, minus


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.repeat(np.arange(len(rows)), [len(r) for r in rows]),
            np.concatenate(rows) if rows else np.zeros(0, np.uint64))


def fingerprints(rows: list[np.ndarray], cells: int = CELLS) -> list[str]:
    """Number of pieces and the cells (count, digest sum, check sum) in base 64."""
    s = Sketches(len(rows), cells)
    row, keys = _flat(rows)
    s.add(row, keys, np.ones(len(keys), np.int64))
    width = HASHES * cells
    packed = np.zeros((len(rows), width), [("n", "<i4"), ("key", "<u8"), ("check", "<u4")])
    packed["n"], packed["key"] = s.count.reshape(-1, width), s.key.reshape(-1, width)
    packed["check"] = (s.check & np.uint64(0xFFFFFFFF)).reshape(-1, width)
    return [f"{len(r)}:{base64.b64encode(p.tobytes()).decode()}" for r, p in zip(rows, packed, strict=True)]


def likeness(a: list[np.ndarray], b: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Shared pieces over all pieces of each pair of versions, from what peeling the difference
    of their sketches recovers. Pairs that can't be peeled get sketches ``GROW`` times larger
    until they can; two pieces of one version with the same 64-bit digest could never be, so a pair
    with far more cells than pieces is compared by its sorted digests. Two versions without pieces
    are alike (1)."""
    out = np.ones(len(a))
    todo = np.arange(len(a))
    while len(todo):
        s = Sketches(len(todo), cells)
        for side, sign in ((a, 1), (b, -1)):
            row, keys = _flat([side[i] for i in todo])
            s.add(row, keys, np.full(len(keys), sign, np.int64))
        done, only_a, only_b = s.peel()
        n_a = np.array([len(a[i]) for i in todo])
        out[todo[done]] = ((n_a - only_a) / np.maximum(1, n_a + only_b))[done]
        empty = done & (n_a + only_b == 0)
        out[todo[empty]] = 1.0
        todo, cells = todo[~done], cells * GROW
        for i in todo[[cells > 64 + 8 * GROW * (len(a[i]) + len(b[i])) for i in todo]] if len(todo) else todo:
            (x, n_x), (y, n_y) = (np.unique(side[i], return_counts=True) for side in (a, b))
            _, at_x, at_y = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            both = int(np.minimum(n_x[at_x], n_y[at_y]).sum())
            out[i] = both / (len(a[i]) + len(b[i]) - both)
        todo = todo[[cells <= 64 + 8 * GROW * (len(a[i]) + len(b[i])) for i in todo]] if len(todo) else todo
    return out


def with_next(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, text, next``: the text of the following document in descending doc_id
    order; the first follows the last. Equal ids are ordered by a hash of their texts, null ids
    come last.

    The documents are dealt into ranges of ids by approximate quantiles (a few numbers for each
    partition), and each range also gets a copy of the first document of the range after it, so
    every text is shuffled once and no window spans more than a range."""
    spark = docs.sparkSession
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    ranges = 4 * parts(spark)
    cuts = sorted(set(docs.where(F.col("doc_id").isNotNull()).approxQuantile(
        "doc_id", [k / ranges for k in range(1, ranges)], 1 / (4 * ranges))))
    steps = [1 << k for k in reversed(range(max(1, len(cuts)).bit_length()))]
    bounds = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    # binary search: the number of cuts below the id
    place = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, step: F.when(
        F.coalesce(F.get(bounds, at + step - 1) < F.col("doc_id"), F.lit(False)), at + step).otherwise(at))
    d = d.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(place))
    first = (d.groupBy("bucket").agg(F.max(F.struct(F.col("doc_id").alias("id"), F.col("th").alias("h"))).alias("m"))
             .select("bucket", "m.id", "m.h").orderBy(F.col("bucket").desc()).collect())
    # the first document of a range goes to the range before it too, that of the top one to the last
    heads = [(first[k].bucket, first[k].id, first[k].h, first[k - 1].bucket) for k in range(len(first))]
    copies = spark.createDataFrame(heads, "in_bucket int, id long, h long, to_bucket int")
    tails = (d.join(F.broadcast(copies), (F.col("bucket") == F.col("in_bucket")) & F.col("doc_id").eqNullSafe(F.col("id"))
                    & (F.col("th") == F.col("h")))
             .select("doc_id", "text", "th", F.col("to_bucket").alias("bucket"), F.lit(1).alias("tail")))
    w = W.partitionBy("bucket").orderBy("tail", F.col("doc_id").desc_nulls_last(), F.col("th").desc())
    return (d.withColumn("tail", F.lit(0)).unionByName(tails).withColumn("next", F.lead("text").over(w))
            .where("tail = 0").select("doc_id", "text", "next"))


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def fingerprint_documents(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as
    many (or all) of the next document in descending doc_id order. ``near_edited`` and
    ``near_next`` are the likeness to the edited text and to the next document.

    Null text: empty. Null doc_id: ordered after all ids. Equal texts have equal fingerprints.
    A single document follows itself. No rows give no rows."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    pairs = with_next(docs).withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next"), F.lit(1), half)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                batch = whole.slice(at, ROWS)
                text, edited, after = ([digests(t) for t in batch.column(c).to_pylist()] for c in ("text", "edited", "next"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("n_chars"), batch.column("edited_sha256"),
                     pa.array(fingerprints(text, cells)), pa.array(fingerprints(edited, cells)),
                     pa.array(likeness(text, edited, cells)), pa.array(likeness(text, after, cells))],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    binary = lambda c: F.col(c).cast("binary").alias(c)
    return pairs.select(
        F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        binary("text"), binary("edited"), binary("next")).mapInArrow(run, RESULT)


def op10_fingerprint(spark, sf_dir):
    """Contract digest: ``fingerprint_documents`` over all documents."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))
