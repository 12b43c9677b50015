"""Sinks and the store snapshot loader (#4-#6).

Tables are written as new version folders ``<root>/<name>/v=<version>`` and
never overwritten in place; readers take the newest complete version. Writing an
existing version raises, so no write vanishes; replayed stream batches are known
by the marker that is published with their version (``leadlake.streaming``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.session import _fs, publish_table
from leadlake.sources import schemas as S


def save_table(df: DataFrame, root: str, name: str, version: int | str) -> str:
    """#5: write ``df`` as version ``version`` of table ``name`` (atomic publish). A
    version that exists, complete or broken, raises ``FileExistsError``."""
    path = f"{root.rstrip('/')}/{name}/v={version}"
    publish_table(df, path)
    return path


def versions(spark: SparkSession, root: str, name: str) -> list[str]:
    fs, p = _fs(spark, f"{root.rstrip('/')}/{name}")
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        n = st.getPath().getName()
        if n.startswith("v=") and ".tmp-" not in n and fs.exists(
                spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath().toString() + "/_SUCCESS")):
            out.append(n[2:])
    return sorted(out, key=lambda v: (len(v), v))


def read_table(spark: SparkSession, root: str, name: str, schema) -> DataFrame:
    """Newest complete version of a table, or an empty typed frame."""
    vs = versions(spark, root, name)
    if not vs:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}/v={vs[-1]}")


def load_store(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """#4: store snapshot documents (each with ``searches``, ``runs``, ``leads``
    arrays) -> three typed tables. ``multi_line=True`` reads the application's
    single pretty-printed document (one task per file, as the format demands);
    ``False`` reads JSON Lines, one bounded document per line, in parallel. A
    missing or unreadable document gives empty tables (PERMISSIVE mode drops
    malformed documents). Timestamps are ``YYYY-MM-DD HH:MM:SS`` UTC strings."""
    from pyspark.sql import types as T
    ts_fields = {"created_at", "started_at", "finished_at", "updated_at"}

    def as_json(st: T.StructType) -> T.StructType:
        return T.StructType([T.StructField(f.name, T.StringType() if f.name in ts_fields else f.dataType)
                             for f in st.fields])

    lead_json = T.StructType([T.StructField(n, T.StringType() if c in ts_fields else _json_type(S.STORED_LEAD[c].dataType))
                              for n, c in _LEAD_JSON_NAMES])
    doc = T.StructType([
        T.StructField("searches", T.ArrayType(as_json(S.SEARCHES))),
        T.StructField("runs", T.ArrayType(as_json(S.RUNS))),
        T.StructField("leads", T.ArrayType(lead_json)),
    ])
    empty = (spark.createDataFrame([], S.SEARCHES), spark.createDataFrame([], S.RUNS),
             spark.createDataFrame([], S.STORED_LEAD))
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return empty
    raw = spark.read.schema(doc).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)

    def ts(c):
        return F.to_timestamp(F.col(c), "yyyy-MM-dd HH:mm:ss")

    s = raw.select(F.explode("searches").alias("r")).select("r.*")
    s = s.select(*[ts(f.name).alias(f.name) if f.name in ts_fields else F.col(f.name) for f in S.SEARCHES.fields])
    r = raw.select(F.explode("runs").alias("r")).select("r.*")
    r = r.select(*[ts(f.name).alias(f.name) if f.name in ts_fields else F.col(f.name) for f in S.RUNS.fields])
    l = raw.select(F.explode("leads").alias("r")).select("r.*")
    # structs are cast by position: camelCase document names to the table's names
    l = l.select(*[(ts(n) if c in ts_fields else F.col(n).cast(S.STORED_LEAD[c].dataType)).alias(c) for n, c in _LEAD_JSON_NAMES])
    return s, r, l


def load_counters(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """#4: the id counters of a store document, one row ``(next_search_id, next_run_id,
    next_lead_id)``: the ids to be given next, above every id ever given. Null for counters
    the document doesn't have; one row of nulls for a missing document."""
    names = [(_camel(c), c) for c in ("next_search_id", "next_run_id", "next_lead_id")]
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([(None, None, None)], ", ".join(f"{c} long" for _, c in names))
    raw = spark.read.schema(", ".join(f"{n} long" for n, _ in names)).option(
        "multiLine", multi_line).option("mode", "PERMISSIVE").json(path)
    return raw.agg(*[F.max(n).alias(c) for n, c in names])


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def _json_type(t):
    """The document's form of a type: struct fields in camelCase."""
    from pyspark.sql import types as T
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField("hasH1" if f.name == "has_h1" else _camel(f.name), _json_type(f.dataType)) for f in t.fields])
    if isinstance(t, T.ArrayType):
        return T.ArrayType(_json_type(t.elementType))
    return t


# JSON document field names of a stored lead -> table column names.
_LEAD_JSON_NAMES = [
    ("id", "id"), ("name", "name"), ("domain", "domain"), ("website", "website"),
    ("description", "description"), ("query", "query"), ("channels", "channels"), ("outreach", "outreach"),
    ("seo", "seo"), ("score", "score"), ("opportunityScore", "opportunity_score"),
    ("issuesCount", "issues_count"), ("hasEmail", "has_email"), ("scoreReasons", "score_reasons"),
    ("status", "status"), ("notes", "notes"), ("runId", "run_id"), ("createdAt", "created_at"),
    ("updatedAt", "updated_at"),
]


def export_leads_csv(view: DataFrame, path: str) -> str:
    """#6: CSV with the 15-column header; a cell is quoted only when it contains
    a quote, comma or newline, quotes doubled; nulls are empty cells. Writes one
    file per partition (Spark's writer); order the view before writing for a
    single ordered file via ``coalesce(1)`` only when it is known to be small."""
    (view.write.mode("overwrite")
         .option("header", True).option("quote", '"').option("escape", '"')
         .option("emptyValue", "").option("nullValue", "")
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
         .option("lineSep", "\n")
         .csv(path))
    return path
