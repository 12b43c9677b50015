"""Joins and groupings along time: as-of join, interval join, sessions, follow-ups.

All of them are equi-joins, aggregates and windows on a key plus a bounded stretch of time, so
that neither a key with a third of all rows nor a long interval meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_SLICE = 100_000   # rows of one key that a window of the as-of join holds, about
BIN_SECONDS = 3600         # shortest bin of the interval join
BIN_GROWTH = 4             # each level's bins are so many times longer


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, columns: Sequence[str], tie: str,
              strict: bool = False, forward: bool = False, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Every row of ``left`` with ``columns`` of the latest row of ``right`` of the same ``key`` whose
    ``right_time`` isn't after ``left_time`` (with ``strict``: is before it); nulls where there is none.
    ``forward`` turns time round: the earliest right row that isn't before (with ``strict``: is after) the left one.

    Of right rows at one time the one with the largest ``tie`` counts. Left rows without key or time
    match nothing; right rows without them are ignored. Left rows are all returned, repeated ones too.

    Both sides are stacked and one window per key carries the last right row along, so nothing is
    paired. A key with more than ``rows_per_slice`` rows is cut into slices of equal time; the last right
    row of each slice is aggregated first and carried into the slices after it, of which a key has few."""
    way = -1 if forward else 1
    right_first = (1, 0) if not strict else (0, 1)
    r_type = right.select(F.struct(F.col(tie).alias("_tie"), *columns).alias("r")).schema["r"].dataType
    l_type = left.select(F.struct(*left.columns).alias("l")).schema["l"].dataType
    lefts = left.select(F.col(key).alias("_k"), (way * _micros(F.col(left_time))).alias("_t"), F.lit(right_first[0]).alias("_side"),
                        F.struct(*left.columns).alias("_l"), F.lit(None).cast(r_type).alias("_r"))
    rights = right.select(F.col(key).alias("_k"), (way * _micros(F.col(right_time))).alias("_t"), F.lit(right_first[1]).alias("_side"),
                          F.lit(None).cast(l_type).alias("_l"), F.struct(F.col(tie).alias("_tie"), *columns).alias("_r"))
    timed = F.col("_k").isNotNull() & F.col("_t").isNotNull()
    rows = lefts.where(timed).unionByName(rights.where(timed))

    large = (rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_from"), F.max("_t").alias("_to"))
             .where(F.col("_n") > rows_per_slice)
             .select("_k", "_from", (F.floor((F.col("_to") - F.col("_from")) / F.ceil(F.col("_n") / rows_per_slice)) + 1).cast("long").alias("_step")))
    rows = rows.join(large, "_k", "left").withColumn(
        "_slice", F.coalesce(F.floor((F.col("_t") - F.col("_from")) / F.col("_step")), F.lit(0)).cast("long")).drop("_from", "_step")
    last = F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", F.col("_r._tie"))))
    before = F.last("_last", ignorenulls=True).over(W.partitionBy("_k").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    carried = (rows.groupBy("_k", "_slice").agg(last.alias("_last")).select("_k", "_slice", before.alias("_r")).where(F.col("_r").isNotNull())
               .select("_k", "_slice", F.lit(None).cast("long").alias("_t"), F.lit(-1).alias("_side"), F.lit(None).cast(l_type).alias("_l"), "_r"))
    run = W.partitionBy("_k", "_slice").orderBy(F.col("_t").asc_nulls_first(), "_side", F.col("_r._tie")).rowsBetween(W.unboundedPreceding, 0)
    found = rows.unionByName(carried).withColumn("_hit", F.last("_r", ignorenulls=True).over(run)).where(F.col("_l").isNotNull())
    none = lefts.where(~timed).select("_l", F.col("_r").alias("_hit"))
    return found.select("_l", "_hit").unionByName(none).select("_l.*", *[F.col(f"_hit.{c}").alias(c) for c in columns])


def _level(length: Column, base: int, levels: int) -> Column:
    """The first level whose bins are at least as long as the interval."""
    e = F.lit(levels - 1)
    for k in range(levels - 2, -1, -1):
        e = F.when(length <= base * 1_000_000 * BIN_GROWTH ** k, F.lit(k)).otherwise(e)
    return e


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str],
                  bin_seconds: int = BIN_SECONDS) -> DataFrame:
    """Pairs of a left and a right row with equal ``keys`` whose closed intervals have an instant in
    common, each pair once; a point in time is an interval of two equal columns.

    An interval lies in at most two bins of its own level, the one whose bins are at least as long as it
    is. A pair is found at the higher level of the two, in the bin in which the later of the starts lies;
    so each row is copied twice for its own and every higher level there is, however long intervals are, and
    the join is an equi-join on keys, level and bin. Rows with a null key or end, or which end before they
    start, are in no pair. Columns of the two sides must have different names, but for the keys."""
    def spans(df: DataFrame, span: tuple[str, str], side: str) -> DataFrame:
        s, e = _micros(F.col(span[0])), _micros(F.col(span[1]))
        good = F.lit(True)
        for k in keys:
            good = good & F.col(k).isNotNull()
        return df.where(good & (s <= e)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], s.alias(f"_s{side}"), e.alias(f"_e{side}"),
                                                F.struct(*df.columns).alias(f"_{side}"))

    l, r = spans(left, left_span, "l"), spans(right, right_span, "r")
    longest = max((df.agg(F.max(F.col(f"_e{s}") - F.col(f"_s{s}"))).first()[0] or 0) for df, s in ((l, "l"), (r, "r")))
    levels = 1
    while bin_seconds * 1_000_000 * BIN_GROWTH ** (levels - 1) < longest:
        levels += 1
    width = F.array(*[F.lit(bin_seconds * 1_000_000 * BIN_GROWTH ** k).cast("long") for k in range(levels)])

    def bin_of(t: Column, level: Column) -> Column:
        return F.floor(t / F.get(width, level)).cast("long")

    def binned(df: DataFrame, side: str) -> DataFrame:
        s, e = F.col(f"_s{side}"), F.col(f"_e{side}")
        df = df.withColumn(f"_own{side}", _level(e - s, bin_seconds, levels))
        df = df.select("*", F.explode(F.sequence(F.col(f"_own{side}"), F.lit(levels - 1))).alias("_level"))
        return df.select("*", F.explode(F.sequence(bin_of(s, F.col("_level")), bin_of(e, F.col("_level")))).alias("_bin"))

    on = [*[f"_k{i}" for i in range(len(keys))], "_level", "_bin"]
    j = binned(l, "l").join(binned(r, "r"), on)
    j = j.where((F.col("_level") == F.greatest("_ownl", "_ownr")) & (F.col("_sl") <= F.col("_er")) & (F.col("_sr") <= F.col("_el"))
                & (F.col("_bin") == bin_of(F.greatest("_sl", "_sr"), F.col("_level"))))
    return j.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in right.columns if c not in keys])


def sessions(events: DataFrame, key: str, time: str, gap: str, *aggregates: Column) -> DataFrame:
    """Sessions of every key: rows of it that follow each other within ``gap``. Batch and stream alike.

    Columns: key, ``session_start``, ``session_end`` (last row plus gap), ``n_events`` and the given
    aggregates. Rows without time are in no session; a null key has sessions of its own. On a stream, set the
    watermark first (``with_lateness``); a session is emitted when the watermark passes its end, and later
    rows are dropped. ``spark.sql.sessionWindow.merge.sessions.in.local.partition`` (set by
    ``leadlake.session``) merges sessions in each task before the shuffle, so that a key with many
    rows sends its sessions, not its rows."""
    s = F.session_window(F.col(time), gap)
    g = events.where(F.col(time).isNotNull()).groupBy(s.alias("_s"), F.col(key)).agg(F.count(F.lit(1)).alias("n_events"), *aggregates)
    rest = [c for c in g.columns if c not in ("_s", key)]
    return g.select(key, F.col("_s.start").alias("session_start"), F.col("_s.end").alias("session_end"), *rest)


def with_lateness(events: DataFrame, time: str, delay: str) -> DataFrame:
    """A stream whose rows may be ``delay`` late; ``time`` becomes a timestamp, as watermarks need."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def unanswered(events: DataFrame, key: str, time: str, opens: Column, closes: Column, within: str) -> DataFrame:
    """Rows ``key, opened_at, due_at``: the opening events which no closing event of the key
    follows after them and at most ``within`` later. Events of one key and instant that open are one;
    events without key or time don't count. The next closing event comes from a forward as-of join."""
    def marks(cond: Column, name: str) -> DataFrame:
        return (events.where(F.coalesce(cond, F.lit(False)) & F.col(key).isNotNull() & F.col(time).isNotNull())
                .select(F.col(key), F.col(time).cast("timestamp").alias(name)).distinct())

    j = asof_join(marks(opens, "opened_at"), marks(closes, "closed_at"), key, "opened_at", "closed_at", ["closed_at"], "closed_at",
                  strict=True, forward=True)
    due = F.col("opened_at") + F.expr(f"INTERVAL {within}")
    return j.where(F.col("closed_at").isNull() | (F.col("closed_at") > due)).select(key, "opened_at", due.alias("due_at"))
