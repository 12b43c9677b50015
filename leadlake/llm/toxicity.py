"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.quality import held_out
from leadlake.llm.work import table

BITS = 18            # hashed terms: 2^18 columns
FACTORS = 4          # length of a term's interaction vector
PREFIX = 6           # bytes of a longer word that are a term of their own
SAMPLE_ROWS = 10_000  # labelled rows the model is fitted on, the first by hash of doc_id
L1, L2 = 3.0, 1e-3
L2_PAIRS = 20.0      # L2 of the interaction vectors
STEPS, STEPS_PAIRS = 200, 60
SEED = 7
ROWS = 1000          # texts that are scored together
FOLDS, HELD_OUT = 5, 0
CROSS_FOLDS = 4      # parts of the sample that are scored by a model of the others, to place the cut

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def hashed_terms(text: str | None) -> np.ndarray:
    """Columns of the distinct terms by CRC-32, ascending.

    Terms are the words of ASCII letters, digits and other characters, A-Z lower-cased, and the
    first bytes of longer words, which join the forms of a word that the sample hasn't seen."""
    found = set(_TERM.findall((text or "").encode().lower()))
    found |= {b"^" + t[:PREFIX] for t in found if len(t) > PREFIX}
    return np.unique(np.fromiter((zlib.crc32(t) for t in found), np.int64, len(found)) & ((1 << BITS) - 1))


@dataclass
class Machine:
    """score = sigmoid(bias + sum w_i + sum over pairs <v_i, v_j>) over the terms present.

    Only ``active`` columns have weights (ascending; ``w`` and ``v`` are aligned to them)."""

    bias: float
    active: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """The pairwise sum is half of |sum v|^2 - sum |v|^2, linear in the terms present."""
        out = np.full(len(rows), self.bias)
        if not len(self.active) or not rows:
            return out
        flat = np.concatenate(rows)
        doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        at = np.searchsorted(self.active, flat)
        known = (at < len(self.active)) & (self.active[np.minimum(at, len(self.active) - 1)] == flat)
        at, doc = at[known], doc[known]
        out += np.bincount(doc, self.w[at], len(rows))
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            out += 0.5 * (np.bincount(doc, x, len(rows)) ** 2 - np.bincount(doc, x * x, len(rows)))
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -500, 500)))


def fit(rows: list[np.ndarray], y: np.ndarray, l1: float = L1, l2: float = L2, l2_pairs: float = L2_PAIRS, factors: int = FACTORS,
        steps: int = STEPS, steps_pairs: int = STEPS_PAIRS, seed: int = SEED) -> Machine:
    """Two phases of full-batch AdaGrad on the logistic loss.

    First the additive weights with an L1 penalty, which leaves most terms at zero; then bias,
    weights and the interaction vectors of every term together. In the first half of that second
    phase the weights that are zero stay so, that the vectors don't have to follow them; in its
    second half they may leave zero under the same L1 penalty. Terms seen in one row only carry no
    evidence of interaction and have neither weight nor vector."""
    n, positive = len(rows), float(np.sum(y))
    prior = np.log((positive + 1) / (n - positive + 1))
    none = np.zeros(0, np.int64)
    if not n or positive in (0.0, float(n)):
        return Machine(float(prior), none, np.zeros(0), np.zeros((0, factors)))
    at = np.concatenate(rows).astype(np.int32)
    doc = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    keep = np.flatnonzero(np.bincount(at, minlength=1 << BITS) >= 2)
    place = np.full(1 << BITS, -1, np.int32)
    place[keep] = np.arange(len(keep))
    live = place[at] >= 0
    at, doc = place[at[live]], doc[live]
    bias, bias_sum = float(prior), 1e-6
    w, grad_sum = np.zeros(len(keep)), np.full(len(keep), 1e-6)
    for _ in range(steps):
        err = 1 / (1 + np.exp(-np.clip(bias + np.bincount(doc, w[at], n), -30, 30))) - y
        g = np.bincount(at, err[doc], len(w))
        grad_sum += g * g
        rate = 0.3 / np.sqrt(grad_sum)
        moved = w - rate * g
        w = np.sign(moved) * np.maximum(0, np.abs(moved) - rate * l1)
        g0 = err.sum()
        bias_sum += g0 * g0
        bias -= 0.3 / np.sqrt(bias_sum) * g0
    weighed = w != 0
    v = np.random.default_rng(seed).normal(0, 0.01, (len(keep), factors))
    w_sum, v_sum = np.full(w.shape, 1.0), np.full(v.shape, 1.0)
    for step in range(steps_pairs if len(keep) else 0):
        sums = np.stack([np.bincount(doc, v[at, f], n) for f in range(factors)], axis=1)
        squares = np.bincount(doc, np.square(v).sum(axis=1)[at], n)
        margin = bias + np.bincount(doc, w[at], n) + 0.5 * (np.square(sums).sum(axis=1) - squares)
        err = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y
        of_row = err[doc]
        total = np.bincount(at, of_row, len(w))
        gw = total + l2 * w
        gv = np.stack([np.bincount(at, of_row * sums[doc, f], len(w)) for f in range(factors)], axis=1) - total[:, None] * v + l2_pairs * v
        w_sum += gw * gw
        v_sum += gv * gv
        rate = 0.05 / np.sqrt(w_sum)
        moved = w - rate * gw
        others = np.sign(moved) * np.maximum(0, np.abs(moved) - rate * l1) if 2 * step >= steps_pairs else 0.0
        w = np.where(weighed, moved, others)
        v = v - 0.05 / np.sqrt(v_sum) * gv
        g0 = err.sum()
        bias_sum += g0 * g0
        bias -= 0.05 / np.sqrt(bias_sum) * g0
    return Machine(float(bias), keep, w, v)


def train(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT,
          sample_rows: int = SAMPLE_ROWS, cross_folds: int = CROSS_FOLDS, **options) -> Machine:
    """Fit on the first ``sample_rows`` labelled documents outside the held-out fold by hash of
    doc_id. The ids and labels of the sample are broadcast; the executors hash its texts, and
    the term columns of at most ``sample_rows`` rows come to the driver, which hands them to the
    tasks that fit."""
    sample = (labels.where(F.col("toxic").isin(0, 1) & ~held_out(folds, fold))
              .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
              .select(F.col("doc_id").alias("_id"), "y"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "cols": [
                hashed_terms(t).astype(np.int32).tobytes() for t in f["text"]]})

    rows = (docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
            .select("doc_id", "y", "text").mapInPandas(run, "doc_id long, y int, cols binary").toPandas())
    rows = rows.sort_values(["doc_id", "cols"])  # the same order, and so the same sums, in every run
    return _fit_in_tasks(docs.sparkSession, list(rows["cols"]), rows["y"].to_numpy(float), cross_folds, options)


def best_cut(margins: np.ndarray, y: np.ndarray) -> float:
    """The cut with the fewest errors: halfway between neighbouring margins, or 0; of equal ones the nearest to 0."""
    m, at = np.unique(margins, return_inverse=True)
    if len(m) < 2:
        return 0.0
    missed = np.cumsum(np.bincount(at, y, len(m)))[:-1]
    wrong = np.cumsum(np.bincount(at, 1 - y, len(m))[::-1])[::-1][1:]
    cuts = np.append((m[:-1] + m[1:]) / 2, 0.0)
    errors = np.append(missed + wrong, np.sum((margins >= 0) != (y > 0)))
    return float(cuts[np.lexsort((np.abs(cuts), errors))[0]])


def _fit_in_tasks(spark, cols: list[bytes], y: np.ndarray, folds: int, options: dict) -> Machine:
    """The machine of all sampled rows, its bias moved so that 0 is the best cut between the classes.

    Every row is also scored by a machine fitted without its part of the sample (equal rows are in
    one part), because margins of rows that were fitted lie too far apart. Each fit is a task of its own."""
    part = np.array([zlib.crc32(b) % folds for b in cols], np.int64)
    shared = spark.sparkContext.broadcast((cols, y, part))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols, y, part = shared.value
        rows = [np.frombuffer(b, np.int32) for b in cols]
        for f in frames:
            for k in f["id"]:
                use = np.flatnonzero(part != k)
                m = fit([rows[i] for i in use], y[use], **options)
                out = m.margins([rows[i] for i in np.flatnonzero(part == k)])
                whole = k == folds
                yield pd.DataFrame({"k": [k], "bias": [m.bias], "active": [m.active.astype(np.int64).tobytes() if whole else b""],
                                    "w": [m.w.tobytes() if whole else b""], "v": [m.v.tobytes() if whole else b""], "margins": [out.tobytes()]})

    fits = {r.k: r for r in spark.range(0, folds + 1, 1, folds + 1).mapInPandas(
        run, "k long, bias double, active binary, w binary, v binary, margins binary").collect()}
    margins = np.zeros(len(cols))
    for k in range(folds):
        margins[part == k] = np.frombuffer(fits[k].margins)
    m, active = fits[folds], np.frombuffer(fits[folds].active, np.int64)
    v = np.frombuffer(m.v).reshape(len(active), -1) if len(active) else np.zeros((0, 1))
    return Machine(m.bias - best_cut(margins, y), active, np.frombuffer(m.w), v)


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, fold: int = HELD_OUT,
                   sample_rows: int = SAMPLE_ROWS, **options) -> DataFrame:
    """Rows ``doc_id, held_out, score, predicted`` for every row of ``docs``, without a shuffle.

    Null or empty text: no terms, so the score of the bias. Null doc_id: scored, never learnt
    from. Null labels are skipped; of repeated label rows the higher counts. Without both
    classes every score is the smoothed share of class 1. No rows give no rows."""
    # at most 2^18 columns of a weight and FACTORS numbers
    m = train(docs, labels, folds, fold, sample_rows, **options)
    shared = docs.sparkSession.sparkContext.broadcast((m.bias, m.active, m.w, m.v))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        model = Machine(*shared.value)
        found = [model.score([hashed_terms(t) for t in text[k:k + ROWS]]) for k in range(0, len(text), ROWS)]
        return pd.Series(np.concatenate(found) if found else [], dtype="float64")

    return docs.select("doc_id", held_out(folds, fold).alias("held_out"), score("text").alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int"))


def op2_toxicity(spark, sf_dir):
    """Contract digest of ``score_toxicity`` over all documents."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
