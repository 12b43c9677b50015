"""Quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.work import saved, table

SHRINK = 0.1     # weight of the pooled covariance in each class covariance
RIDGE = 1e-3     # share of the mean variance added to the diagonal
FOLDS, HELD_OUT = 3, 1

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_LEAD = (_BYTES & 0xC0) == 0xC0       # first byte of a non-ASCII character
_TAIL = (_BYTES & 0xC0) == 0x80
_STOP = np.isin(_BYTES, [ord(c) for c in ".,;:"])
_CRY = np.isin(_BYTES, [ord(c) for c in "!?"])
_MARK = np.isin(_BYTES, [ord(c) for c in "#$%&*+/<=>@\\^_`{|}~[]"])
_GAP = np.isin(_BYTES, [32, 9, 10, 11, 12, 13])

#: names of the statistics, in the order of the vector
STATISTICS = ("log_words", "word_chars", "upper", "digit", "foreign", "stop", "cry", "mark", "other",
              "distinct_words", "repeated_lines", "line_words")


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of a text: counts by log1p, shares by square root, which bring
    the skewed raw values near a normal shape. An empty or null text has none of anything."""
    raw = (text or "").encode()
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    chars = max(1, len(raw) - int(count[_TAIL].sum()))
    n = max(1, len(words))
    share = lambda kind: count[kind].sum() / chars
    letters = max(1, count[_UPPER].sum() + count[_LOWER].sum())
    known = share(_UPPER | _LOWER | _DIGIT | _LEAD | _STOP | _CRY | _MARK | _GAP)
    return np.array([
        np.log1p(len(words)), np.log1p(chars / n), np.sqrt(count[_UPPER].sum() / letters), np.sqrt(share(_DIGIT)),
        np.sqrt(share(_LEAD)), np.sqrt(share(_STOP)), np.sqrt(share(_CRY)), np.sqrt(share(_MARK)),
        np.sqrt(max(0.0, 1 - known)), len(set(words)) / n,
        1 - len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines)))])


def document_statistics(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``x array<double>``, one row per document."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["x"] = [statistics(t) for t in f.pop("text")]
            yield f

    kept = docs.select(*carry, "text")
    schema = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in kept.schema if c.name != "text")
    return kept.mapInPandas(run, f"{schema}, x array<double>")


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors and log determinants; classes 0 and 1."""

    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]
    constant: float | None = None  # the score where one class is all there is

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for the rows of ``x``."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        logs = [o - 0.5 * np.square((x - m) @ f.T).sum(axis=1)
                for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrink: float = SHRINK,
        ridge: float = RIDGE) -> Discriminant:
    """From the count, sum and sum of outer products of each class.

    Class covariance = (1 - shrink) own + shrink pooled + ridge * mean variance * I; its Cholesky
    factor is inverted once here and only multiplied afterwards."""
    n = {c: moments[c][0] if c in moments else 0.0 for c in (0, 1)}
    if min(n.values()) < 2:
        return Discriminant([], [], [], (n[1] + 1) / (n[0] + n[1] + 2))
    means = {c: moments[c][1] / n[c] for c in n}
    own = {c: moments[c][2] / n[c] - np.outer(means[c], means[c]) for c in n}
    total = sum(n.values())
    pooled = sum(n[c] / total * own[c] for c in n)
    spread = max(float(np.trace(pooled)) / len(pooled), 1e-9)
    factors, offsets = [], []
    for c in (0, 1):
        cov = (1 - shrink) * own[c] + shrink * pooled + ridge * spread * np.eye(len(pooled))
        low = np.linalg.cholesky(cov)
        factors.append(np.linalg.inv(low))
        offsets.append(float(np.log(n[c] / total) - np.log(np.diag(low)).sum()))
    return Discriminant([means[0], means[1]], factors, offsets)


def class_moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and outer products of ``x`` by ``label`` over all rows: each batch sends a row
    of partial sums for each class, Spark adds them up, and two rows come to the driver."""
    d = len(STATISTICS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for label, g in f.groupby("label"):
                x = np.stack(g["x"].to_list())
                row = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
                yield pd.DataFrame({"label": [int(label)] * len(row), "k": range(len(row)), "v": row})

    sums = labelled.mapInPandas(run, "label int, k int, v double").groupBy("label", "k").agg(F.sum("v").alias("v"))
    out: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}
    flat: dict[int, np.ndarray] = {}
    for r in sums.collect():  # two classes of 1 + d + d * d numbers
        flat.setdefault(r.label, np.zeros(1 + d + d * d))[r.k] = r.v
    for c, v in flat.items():
        out[c] = (float(v[0]), v[1:1 + d], v[1 + d:].reshape(d, d))
    return out


def held_out(folds: int, fold: int):
    """Whether crc32 of the id as text falls into the held-out fold (a null id doesn't)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT,
                  shrink: float = SHRINK, ridge: float = RIDGE) -> DataFrame:
    """Rows ``doc_id, th, held_out, score, predicted`` for every row of ``docs``.

    The statistics of each text are computed once and written out; the fit reads those of all
    labelled rows outside the held-out fold, the score reads all. Nothing but the text enters.

    Null or empty text: the statistics of no words. Null doc_id: scored, never learnt from.
    Null labels are skipped; repeated label rows each count. Fewer than two rows of a class:
    every score is the smoothed share of class 1. No rows give no rows."""
    stats = saved(document_statistics(
        docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text"),
        ("doc_id", "th")), "quality-statistics").withColumn("held_out", held_out(folds, fold))
    learn = labels.where(F.col("quality").isin(0, 1)).select(
        F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("label"))
    labelled = stats.where(~F.col("held_out")).join(learn, F.col("doc_id") == F.col("_id")).select("label", "x")
    model = fit(class_moments(labelled), shrink, ridge)

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_list())) if len(x) else [], dtype="float64")

    return stats.select("doc_id", "th", "held_out", score("x").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose predicted quality is 1."""
    bad = score_quality(docs, labels, **options).where("predicted = 0").select(
        F.col("doc_id").alias("_bad_id"), F.col("th").alias("_bad_th")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"])
                     & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["_bad_th"]), "left_anti")


def op6_quality(spark, sf_dir):
    """Contract digest of ``score_quality`` over all documents."""
    s = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return s.select("doc_id", "held_out", "score", "predicted")
