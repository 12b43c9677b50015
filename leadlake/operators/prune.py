"""Semi-joins of a wide table with few keys: its other rows go in the scan, before anything is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRUNE_KEYS = 500_000  # hashes of 8 bytes that are sent to every executor, at most


def prune(rows: DataFrame, columns: list[str], keys: DataFrame, limit: int = PRUNE_KEYS) -> DataFrame:
    """The rows whose ``columns`` may be a row of ``keys`` (as many columns of the same types, in this order).

    Compares 64-bit hashes, so a row without a key may stay: an exact join must follow, which then shuffles
    only these rows. With more than ``limit`` keys nothing is left out and that join takes all rows.
    ``keys`` is computed twice; pass a checkpointed one."""
    if keys.count() > limit:
        return rows
    hashes = keys.select(F.xxhash64(*keys.columns).alias("_kh"))
    return rows.join(F.broadcast(hashes), F.xxhash64(*columns) == F.col("_kh"), "left_semi")
