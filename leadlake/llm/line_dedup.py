"""Line deduplication across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadlake.llm.work import SPACE, ascii_lower, saved, table

MIN_CHARS = 40  # shorter keys are never counted
MIN_DOCS = 5    # a key found in so many documents is a repeated line


def _lines():
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Rows ``doc_id, th, pos, h1, h2`` of the lines whose key is long enough.

    ``th`` tells apart rows that share an id; ``(h1, h2)`` is a 128-bit hash of the key."""
    key = ascii_lower(F.btrim(F.col("line"), F.lit(SPACE)))
    exploded = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
                           F.posexplode(_lines()).alias("pos", "line"))
    return (exploded.select("doc_id", "th", "pos", key.alias("key"))
            .where(F.char_length("key") >= min_chars)
            .select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2")))


def drop_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Rows ``doc_id, text, n_lines, n_dropped``: each document without its repeated lines.

    A text is split at \\n; a line's key is the line stripped of ASCII white space, A-Z
    lower-cased. Keys of at least ``min_chars`` code points found in ``min_docs`` documents or
    more lose their lines everywhere but in the largest doc_id that holds them; all other
    lines stay as they are, joined by \\n in their order.

    Only hashes are shuffled for the counts, pre-aggregated per (line, document), so a line
    that a third of all documents hold is spread by document. The repeated lines are written
    out before they are joined back, so the join sees two plain shuffles with known sizes:
    the optimizer broadcasts a small side and splits a skewed one. The dropped positions of
    a document, never its copies in other documents, meet in one row.

    Null text: one empty line. Null doc_id: not a document to count and never the keeper, so
    such a row loses every repeated line. Repeated rows of one id count as one document and
    are each returned. No rows give no rows."""
    docs = docs.select("doc_id", "text")
    lines = _hashed_lines(docs, min_chars)
    repeated = (lines.where(F.col("doc_id").isNotNull()).select("h1", "h2", "doc_id").distinct()
                .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
                .where(F.col("n") >= min_docs).select("h1", "h2", "keeper"))
    repeated = saved(repeated, "repeated-lines")
    dropped = (lines.join(repeated, ["h1", "h2"])
               .where(F.col("doc_id").isNull() | (F.col("doc_id") != F.col("keeper")))
               .groupBy(F.col("doc_id").alias("d_id"), F.col("th").alias("d_th"))
               .agg(F.collect_set("pos").alias("dropped")))
    whole = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit("")))).join(
        dropped, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("th") == F.col("d_th")), "left")
    whole = whole.select("doc_id", _lines().alias("lines"), "dropped")
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    joined = F.array_join(F.transform(kept, lambda p: F.get("lines", p)), "\n")
    return whole.select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.array_join("lines", "\n")).otherwise(joined).alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def op1_line_dedup(spark, sf_dir):
    """Contract digest of ``drop_repeated_lines`` over all documents."""
    r = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return r.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
      FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
