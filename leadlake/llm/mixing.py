"""Mixing sources to target weights: capped water-filling, seeded repetitions (native)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadlake.llm.work import NOT_SPACE, saved

WEIGHTS = (3.0, 1.0, 2.0)  # by source in code point order, repeating; null last
BUDGET = 1.5               # words of the mix per word of the corpus
MAX_EPOCHS = 2.0           # no source (and no document) is repeated more often
SEED = "mix-1"
BUCKET_DIGITS = 3          # 16^3 hash buckets per source carry the running sums


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One narrow row per document: its words, its source key and its seeded draw.

    ``src`` sorts by code point with the null source last. ``draw`` is the hex MD5 of seed
    and id (a null id draws as the empty string). A null text has size 0."""
    return docs.select(
        "doc_id", "source",
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source"))).alias("src"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(NOT_SPACE)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("draw"))


def water_fill(sources: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET,
               max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets of the sources (rows ``src, source_size``): the fix point of clamping at
    ``max_epochs`` times the size and resharing the excess by weight.

    With sources in ascending order of cap / weight, those before a source are clamped if it
    is; the level left for it and those after is (budget - caps before) / weights from here.
    That level is highest at the first source which is not clamped, so the water level is the
    maximum and every target is ``least(cap, level * weight)``. The windows run over one row
    per source, never over documents."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(W.orderBy("src")) - 1
    s = (sources.withColumn("weight", F.get(cycle, place % len(weights)))
         .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))))
    order = W.orderBy(F.col("cap") / F.col("weight"), "src")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    whole = F.sum("source_size").over(W.partitionBy()) * F.lit(float(budget))
    s = s.withColumn("level", (whole - before) / rest)
    level = F.max("level").over(W.partitionBy())
    return s.select("src", "source_size", "weight", F.least("cap", level * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget: float = BUDGET,
        max_epochs: float = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Rows ``doc_id, source, size, source_size, target, repeats, taken``, one per document.

    Every document is taken floor(target / source_size) whole times; the fraction that is left
    goes to the documents of the source in the order of their draw until it is used up (the
    document that crosses the line is in if at least half of it fits), so a source misses its
    target by half a document at most. Running sums are kept per (source, hash bucket): the sums
    of the buckets give each bucket's start, and a window orders only the documents of one
    bucket, so a source with a third of all rows is spread over all tasks.

    Null text: size 0. Null source: a source of its own, last. Repeated ids draw alike and are
    ordered by size. No rows give no rows. Reruns agree."""
    d = saved(sizes(docs, seed).withColumn("bucket", F.substring("draw", 1, BUCKET_DIGITS)), "mix-sizes")
    buckets = d.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"))
    plan = water_fill(buckets.groupBy("src").agg(F.sum("bucket_size").alias("source_size")),
                      weights, budget, max_epochs)
    start = F.coalesce(F.sum("bucket_size").over(
        W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = buckets.select("src", "bucket", start.alias("start")).join(plan, "src")
    run = F.sum("size").over(W.partitionBy("src", "bucket").orderBy("draw", "doc_id", "size")
                             .rowsBetween(W.unboundedPreceding, W.currentRow))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    j = d.join(starts, ["src", "bucket"]).withColumn("reach", F.col("start") + run - F.col("size") / 2.0)
    left = F.col("target") - epochs * F.col("source_size")
    extra = F.when((left > 0) & (F.col("reach") <= left), F.lit(1)).otherwise(F.lit(0))
    repeats = (epochs + extra).cast("long")
    return j.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"),
                    repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as it is taken.

    Rows without words are taken as often as their draw says, so an empty source goes."""
    plan = mix(docs, **options).where(F.col("repeats") > 0).groupBy(F.col("doc_id").alias("mix_id")).agg(F.max("repeats").alias("n"))
    whole = docs.select(F.struct("*").alias("row"))
    return (whole.join(plan, F.col("row.doc_id").eqNullSafe(F.col("mix_id")))
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("row.*"))


def op9_mixing(spark, sf_dir):
    """Contract digest of ``mix`` over all documents."""
    from leadlake.llm.work import table
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", "taken")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][1 + CAST((row_number() OVER (ORDER BY src) - 1) % 3 AS INT)] AS weight,
             source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT src, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS remaining,
        sum(size) OVER (PARTITION BY d.src ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS reach
      FROM d JOIN e ON d.src = e.src)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (epochs + CASE WHEN remaining > 0 AND reach <= remaining THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
