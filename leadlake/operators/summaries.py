"""Summaries of the lead table and of captured rows: subtotals, mergeable sketches, global ranks, quantiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leadlake.operators.store import sequential_ids

HLL_BITS = 12  # 2^12 registers: a relative standard error of about 1.6 %


# ------------------------------------------------------------------ subtotals

def _totals(leads: DataFrame, dims: Sequence[str], sets: Sequence[Sequence[str]]) -> DataFrame:
    """Counts by the given grouping sets of ``dims``.

    Rows are aggregated at the finest level first and only those groups are expanded, so the
    copies that grouping sets make don't grow with the table."""
    fine = leads.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if("has_email").alias("_mail"), F.sum(F.col("score").cast("long")).alias("_score"),
        F.count("score").alias("_scored"), F.count_if(F.col("score") >= 70).alias("_hot"))
    g = fine.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(
        F.grouping_id().alias("grouping_id"), *[F.grouping(c).cast("boolean").alias(f"{c}_is_total") for c in dims],
        F.sum("_n").alias("leads"), F.sum("_mail").alias("with_email"), F.sum("_hot").alias("hot"),
        (F.sum("_score") / F.sum("_scored")).alias("avg_score"))
    return g.select(*dims, "grouping_id", *[f"{c}_is_total" for c in dims], "leads", "with_email", "hot", "avg_score")


def lead_funnel(leads: DataFrame, hierarchy: Sequence[str], by: str = "status") -> DataFrame:
    """Roll-up of the leads along ``hierarchy`` (outermost first), each level with and without ``by``.

    ``grouping_id`` has a bit for every dimension (``hierarchy``, then ``by``; the last is the lowest) that is
    totalled, and ``<dimension>_is_total`` says the same, which tells a null value from a subtotal."""
    levels = [list(hierarchy[:k]) for k in range(len(hierarchy), -1, -1)]
    return _totals(leads, [*hierarchy, by], [s for level in levels for s in ([*level, by], level)])


def lead_cube(leads: DataFrame, dims: Sequence[str]) -> DataFrame:
    """All subtotals over every subset of ``dims``."""
    sets = [[d for i, d in enumerate(dims) if not mask >> i & 1] for mask in range(1 << len(dims))]
    return _totals(leads, list(dims), sets)


# ------------------------------------------------------------------ sketches of distinct values

def distinct_sketches(rows: DataFrame, keys: Sequence[str | Column], value: str, bits: int = HLL_BITS) -> DataFrame:
    """Rows ``*keys, sketch``: a HyperLogLog sketch of the distinct non-null values of every group. Sketches of a
    few kilobytes are merged in each task before the shuffle, whatever the group's size; they can be stored."""
    return rows.groupBy(*keys).agg(F.hll_sketch_agg(F.col(value), F.lit(bits)).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Union of stored sketches by coarser keys: the sketch of all their rows, in whatever order they are merged."""
    return sketches.groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimate(sketch: str | Column = "sketch") -> Column:
    return F.hll_sketch_estimate(sketch)


# ------------------------------------------------------------------ global ranks and quantiles

def ranked(df: DataFrame, order: Sequence[str | Column]) -> tuple[DataFrame, int]:
    """(``df`` with ``row_no`` 1, 2, ... in the given order, number of rows) without a window over all rows:
    range partitions are numbered by the rows before them. ``order`` should end in a unique column, so that
    equal values can be split over partitions and the result is the same in every run."""
    named = [F.col(o) if isinstance(o, str) else o for o in order]
    numbered = sequential_ids(df, named, 0).withColumnRenamed("new_id", "row_no")
    return numbered, numbered.count()


def global_ntile(df: DataFrame, order: Sequence[str | Column], buckets: int, name: str = "bucket") -> DataFrame:
    """``df`` with its rank bucket 1..``buckets`` over the whole table, as ntile gives it: sizes differ by one
    at most, the larger buckets first. No rows give no rows."""
    r, n = ranked(df, order)
    size, more = divmod(n, buckets)
    at = F.col("row_no") - 1
    if size == 0:
        bucket = at + 1
    else:
        edge = more * (size + 1)
        bucket = F.when(at < edge, F.floor(at / (size + 1)) + 1).otherwise(F.floor((at - edge) / size) + 1 + more)
    return r.withColumn(name, bucket.cast("int")).drop("row_no")


def quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> DataFrame:
    """Rows ``probability, value``: the exact continuous quantiles of the non-null values (interpolated between
    neighbours), from counts per distinct value: one running sum over them in range partitions, then
    the two neighbours of each position. One row of null each if there is no value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    c = counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("_part", F.spark_partition_id()).checkpoint()
    sums = c.groupBy("_part").agg(F.sum("c").alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    c = c.join(sums.select("_part", before.alias("_before")), "_part")
    upto = F.col("_before") + F.sum("c").over(W.partitionBy("_part").orderBy("v"))
    c = c.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("c"))
    n = c.agg(F.sum("c")).first()[0] or 0
    spots = []
    for p in probabilities:
        at = p * (n - 1)
        low = int(at)
        spots.append((float(p), low, min(low + 1, n - 1), at - low))
    want = df.sparkSession.createDataFrame(spots, "probability double, low long, high long, part double")
    def value_at(place: str) -> Column:
        return F.max(F.when((F.col("_from") <= F.col(place)) & (F.col(place) < F.col("_upto")), F.col("v")))
    # the positions are a short list of the call; each task looks its values up in it
    spread = c.select("v", "_from", "_upto", F.explode(F.array(*[F.struct(F.lit(p).alias("probability"), F.lit(lo).cast("long").alias("low"), F.lit(hi).cast("long").alias("high"),
                                                                          F.lit(w).alias("part")) for p, lo, hi, w in spots])).alias("s")).select("v", "_from", "_upto", "s.*")
    near = spread.where(((F.col("_from") <= F.col("low")) & (F.col("low") < F.col("_upto"))) | ((F.col("_from") <= F.col("high")) & (F.col("high") < F.col("_upto"))))
    found = near.groupBy("probability").agg(value_at("low").alias("a"), value_at("high").alias("b"), F.max("part").alias("w"))
    return want.select("probability").join(found, "probability", "left").select(
        "probability", (F.col("a") + (F.col("b") - F.col("a")) * F.col("w")).alias("value"))
