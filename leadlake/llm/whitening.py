"""Embedding whitening: pivoted Cholesky of the centred scatter, one-sided Jacobi on the factor."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.work import saved, table

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000   # x = floor(SCALE * c) + SHIFT
LIMB = 30                      # bits of a limb: exact sums of any size travel as longs
LIMBS = 6
EXACT = 1 << 20                # products of smaller entries add up exactly in doubles, ROWS rows at a time
ROWS = 4096
SWEEPS = 60
_LONG = 1 << 63


def _integers(vectors: pa.ListArray, dim: int) -> np.ndarray:
    """x of the vectors, a row each; all have ``dim`` entries that fit."""
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _limbs(value: int) -> list[int]:
    """``value`` as limbs of ``LIMB`` bits, the last with the sign."""
    out = []
    for _ in range(LIMBS - 1):
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _scatter(y: np.ndarray) -> np.ndarray:
    """Exact sum of y y' over the rows, as Python integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    small = (np.abs(y) < EXACT).all(axis=1)
    near, far = y[small].astype(np.float64), y[~small].astype(object)
    for i in range(0, len(near), ROWS):
        part = near[i:i + ROWS]
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total + far.T @ far if len(far) else total


def fit_vectors(rows: DataFrame) -> DataFrame:
    """The rows whose vector is usable: not null, no null or non-finite entry, every x a long, and as
    many entries as most vectors have (of equally many, the larger number)."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    fits = F.forall(c, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v * SCALE) < 9e18), F.lit(False)))
    good = rows.where(F.col("embedding").isNotNull() & F.coalesce(fits, F.lit(False)))
    top = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return good.where(F.size("embedding") == F.lit(top.dim if top else 0))


def _summed(df: DataFrame) -> dict[tuple[int, int], int]:
    """Exact sums of the limbs by (i, j); as many rows come to the driver as there are (i, j)."""
    cols = [f"l{k}" for k in range(LIMBS)]
    rows = df.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    return {(r.i, r.j): sum(r[c] << (LIMB * k) for k, c in enumerate(cols)) for r in rows}


def _moments(vectors: DataFrame, dim: int, middle: list[int] | None) -> tuple[int, dict[tuple[int, int], int]]:
    """(rows, sums): with ``middle`` null the sums of x by (i, 0); else the sums of y y' by (i, j <= i)
    and of y by (-1, i), where y = x - middle. A task sends each of its sums once, in limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, yy = 0, np.zeros(dim, object), np.zeros((dim, dim), object)
        for batch in batches:
            x = _integers(batch.column("embedding"), dim)
            if middle is not None:
                x = x - np.array(middle, np.int64) if max(map(abs, middle), default=0) < _LONG >> 1 else x.astype(object) - np.array(middle, object)
                yy = yy + _scatter(x)
            n, s = n + len(x), s + x.astype(object).sum(axis=0)
        found = [(-2, 0, n)] + [(-1, i, int(v)) for i, v in enumerate(s)]
        if middle is not None:
            found += [(i, j, int(yy[i, j])) for i in range(dim) for j in range(i + 1)]
        limbs = np.array([_limbs(v) for _, _, v in found], np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), *map(pa.array, limbs.T)],
            names=["i", "j", *[f"l{k}" for k in range(LIMBS)]])

    fields = "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))
    sums = _summed(vectors.select("embedding").mapInArrow(run, fields))
    return sums.get((-2, 0), 0), sums


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """F with F F' = a for a positive semidefinite ``a``: rows permuted by the largest remaining
    diagonal, a lower triangular factor, rows put back. It ends at the numerical rank."""
    a = a.astype(np.float64).copy()
    d = len(a)
    order, factor = np.arange(d), np.zeros((d, d))
    rest, rank = np.diag(a).copy(), 0
    least = d * np.finfo(float).eps * max(rest.max(initial=0.0), 0.0)
    for k in range(d):
        p = k + int(np.argmax(rest[k:]))
        if rest[p] <= least:
            break
        for v in (order, rest):
            v[[k, p]] = v[[p, k]]
        factor[[k, p], :k] = factor[[p, k], :k]
        factor[k, k] = math.sqrt(rest[k])
        below = order[k + 1:]
        factor[k + 1:, k] = (a[below, order[k]] - factor[k + 1:, :k] @ factor[k, :k]) / factor[k, k]
        rest[k + 1:] -= factor[k + 1:, k] ** 2
        rank += 1
    back = np.zeros((d, rank))
    back[order] = factor[:, :rank]
    return back


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of factor factor'.

    Columns are rotated in pairs until all are orthogonal; then the squared norm of a column is an
    eigenvalue and its direction the eigenvector. A sweep goes through all pairs in rounds of disjoint
    ones, as in a tournament, and each round is one numpy operation."""
    u = factor.copy()
    r = u.shape[1]
    seats = np.arange(r + r % 2)
    eps = np.finfo(float).eps
    for _ in range(SWEEPS):
        turned = False
        for _ in range(len(seats) - 1):
            left, right = seats[:len(seats) // 2], seats[len(seats) // 2:][::-1]
            real = (left < r) & (right < r)
            p, q = left[real], right[real]
            seats = np.concatenate([seats[:1], np.roll(seats[1:], 1)])
            a, b = u[:, p], u[:, q]
            alpha, beta, gamma = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            go = np.abs(gamma) > 4 * eps * np.sqrt(alpha * beta)
            if not go.any():
                continue
            turned = True
            p, q, a, b = p[go], q[go], a[:, go], b[:, go]
            zeta = (beta[go] - alpha[go]) / (2 * gamma[go])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            u[:, p], u[:, q] = c * a - c * t * b, c * t * a + c * b
        if not turned:
            break
    values = (u * u).sum(0)
    order = np.argsort(-values, kind="stable")
    values, u = values[order], u[:, order]
    return values, u / np.sqrt(values)


def whitening(vectors: DataFrame, components: int = COMPONENTS) -> dict:
    """The model of the usable vectors (see ``fit_vectors``): ``n``, ``sums`` (exact), ``trace``,
    ``values`` (falling eigenvalues of the covariance of x, positive only) and ``components`` (columns).

    Two passes: sums first, then the scatter of y = x - round(mean). Both are exact integers, so they
    don't depend on the order of rows or tasks; the covariance is rounded once. dim^2 sums reach the driver."""
    first = vectors.select(F.size("embedding").alias("dim")).first()
    dim = first.dim if first else 0
    if not dim:
        return {"n": vectors.count(), "dim": 0, "sums": [], "trace": 0.0, "values": np.zeros(0), "components": np.zeros((0, 0))}
    n, first_sums = _moments(vectors, dim, None)
    sums = [first_sums[-1, i] for i in range(dim)]
    middle = [(2 * s + n) // (2 * n) for s in sums]
    _, found = _moments(vectors, dim, middle)
    y = [found[-1, i] for i in range(dim)]
    v = np.zeros((dim, dim))
    for i in range(dim):
        for j in range(i + 1):
            top, below = n * found[i, j] - y[i] * y[j], n * n
            v[i, j] = v[j, i] = top / below
    values, vectors_ = one_sided_jacobi(pivoted_cholesky(v))
    return {"n": n, "dim": dim, "sums": sums, "trace": float(np.trace(v)), "values": values[:components], "components": vectors_[:, :components]}


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Rows ``vec_id, n, deviation, whitened`` (array, one entry for each component), one per usable
    vector, with the model's ``explained`` (array) and ``identity_error`` beside them.

    ``deviation`` is the exact squared distance of n * x from the sums, null where it exceeds a long.
    Of rank-deficient vectors only the components with a variance are returned, so equal vectors, or a
    single one, give empty arrays. Rows with null, non-finite or oversized entries, or with another
    number of entries than most, are dropped. Repeated rows and ids each count and are each returned.
    No rows give no rows. ``identity_error`` is measured on the whitened rows themselves."""
    usable = saved(fit_vectors(rows.select("vec_id", "embedding")), "whitening-vectors")
    model = whitening(usable, components)
    n, dim, sums, k = model["n"], model["dim"], model["sums"], len(model["values"])
    turn = model["components"] / np.sqrt(model["values"]) if k else np.zeros((dim, 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (n x - S) / n in doubles loses digits if S is large; x less the rounded mean is exact
        middle = np.array([(2 * s + n) // (2 * n) for s in sums], object)
        off = np.array([(s - n * int(m)) / n for s, m in zip(sums, middle, strict=True)])
        for batch in batches:
            x = _integers(batch.column("embedding"), dim)
            far = x.astype(object) - middle
            big = max((abs(int(v)) for v in (far.max(initial=0), far.min(initial=0))), default=0) * n
            rest = np.array([s - n * int(m) for s, m in zip(sums, middle, strict=True)], object)
            if (big + n) ** 2 * dim < _LONG:
                deviation = ((n * far.astype(np.int64) - rest.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                deviation = [int(d) if d < _LONG else None for d in ((n * far - rest) ** 2).sum(axis=1)]
            white = (far.astype(np.float64) - off) @ turn
            offsets = np.arange(0, (len(x) + 1) * k, k, np.int32) if k else np.zeros(len(x) + 1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(deviation, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel(), pa.float64()))],
                names=["vec_id", "deviation", "whitened"])

    if not dim:  # empty vectors, or none
        return usable.select("vec_id", F.lit(n).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
                             F.array().cast("array<double>").alias("whitened"), F.array().cast("array<double>").alias("explained"),
                             F.lit(0.0).alias("identity_error"))
    white = usable.mapInArrow(run, f"vec_id {usable.schema['vec_id'].dataType.simpleString()}, deviation long, whitened array<double>")
    white = saved(white, "whitened")
    error = identity_error(white, k)
    explained = F.array(*[F.lit(float(e / model["trace"])) for e in model["values"]]).cast("array<double>")
    return white.select("vec_id", F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                        explained.alias("explained"), F.lit(error).alias("identity_error"))


def identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the covariance (divisor n) of ``whitened`` minus the identity."""
    if not k:
        return 0.0
    w = [F.get("whitened", i) for i in range(k)]
    r = white.agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(x) for x in w]).alias("mean"),
                  F.array(*[F.avg(w[i] * w[j]) for i in range(k) for j in range(k)]).alias("second")).first()
    mean = np.array(r["mean"])
    return float(np.abs(np.array(r["second"]).reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def op12_whitening(spark, sf_dir):
    """Contract rows of ``whiten`` over all embeddings: one per vector and component."""
    w = whiten(table(spark, sf_dir, "embeddings"))
    each = w.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
                       F.get("explained", F.col("at")).alias("explained"), "identity_error")
