"""Change history of a versioned table: differences of versions, validity periods, rebuilt versions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_hash(columns: Sequence[str]) -> Column:
    """128 bits of a row's values; null, empty and absent values differ."""
    whole = F.to_json(F.struct(*[F.col(c).alias(c) for c in columns]), {"ignoreNullFields": "false"})
    return F.substring(F.sha2(whole.cast("binary"), 256), 1, 32)


def changes(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``key, change, *columns``: ``insert``, ``update`` (with the new values) or ``delete`` (with the old).

    Both versions are compared by key and a hash of the other columns: one full outer join on the key. A
    null key is a key like any other; keys are taken to be unique in a version."""
    columns = [c for c in (columns or new.columns) if c != key]
    o, n = (df.select(F.col(key).alias(f"_{s}_key"), F.lit(True).alias(f"_{s}"), row_hash(columns).alias(f"_{s}_hash"), F.struct(*columns).alias(f"_{s}_row"))
            for df, s in ((old, "old"), (new, "new")))
    j = o.join(n, F.col("_old_key").eqNullSafe(F.col("_new_key")), "full_outer")
    change = (F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "delete")
              .when(F.col("_old_hash") != F.col("_new_hash"), "update"))
    row = F.when(F.col("_new"), F.col("_new_row")).otherwise(F.col("_old_row"))
    return (j.select(F.when(F.col("_new"), F.col("_new_key")).otherwise(F.col("_old_key")).alias(key), change.alias("change"), row.alias("_row"))
            .where(F.col("change").isNotNull()).select(key, "change", "_row.*"))


def change_log(versions: Mapping[int, DataFrame], key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``version, key, change, *columns`` over all versions: the first is all inserts, every other its
    difference from the one before. Append ``changes`` of a new version to a stored log to go on."""
    order = sorted(versions)
    columns = [c for c in (columns or versions[order[0]].columns) if c != key]
    log = versions[order[0]].select(F.lit(order[0]).cast("long").alias("version"), key, F.lit("insert").alias("change"), *columns)
    for a, b in zip(order, order[1:]):
        diff = changes(versions[a], versions[b], key, columns)
        log = log.unionByName(diff.select(F.lit(b).cast("long").alias("version"), key, "change", *columns))
    return log


def periods(log: DataFrame, key: str) -> DataFrame:
    """Rows ``key, valid_from, valid_to, change, previous_change, *columns``: the stretch of versions, the last
    excluded, in which a row had these values; ``valid_to`` is null while it still has them. One window per
    key over its changes: a key has at most one in each version."""
    w = W.partitionBy(key).orderBy("version")
    columns = [c for c in log.columns if c not in ("version", "change", key)]
    p = log.select(key, F.col("version").alias("valid_from"), F.lead("version").over(w).alias("valid_to"), "change",
                   F.lag("change").over(w).alias("previous_change"), *columns)
    return p.where(F.col("change") != "delete")


def version_at(history: DataFrame, version: int, columns: Sequence[str]) -> DataFrame:
    """The table as it was in a version, rebuilt from its ``periods``."""
    live = (F.col("valid_from") <= version) & (F.col("valid_to").isNull() | (F.col("valid_to") > version))
    return history.where(live).select(*columns)
