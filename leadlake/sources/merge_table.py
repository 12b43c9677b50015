"""A lead table in hash buckets: merges append the changed rows, readers fold them, compaction tidies up.

Folders under ``root``::

    base/whole=<n>/bucket=<b>/...  all rows of the table as they were after commit n
    base/seq=<n>/bucket=<b>/...    all rows of some buckets as they were after commit n (compacted)
    delta/seq=<n>/bucket=<b>/...   the rows that commit n inserted or changed

A bucket is its part of the newest base folder that covers it and the later deltas; of a domain the row of the
latest commit counts. A commit is published by one rename with a small ``_meta.json``: the last batch
of every stream that wrote to the table, the next id, the number of buckets. So the newest commit
tells whether a batch was written before, whoever wrote it, and ids of deleted rows never come back.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from leadlake.operators import store as ST
from leadlake.session import _fs
from leadlake.sources import schemas as S

BUCKETS = 64          # buckets of a new table; about 100 MB each is a good size
COMPACT_AFTER = 8     # deltas of a bucket beyond which ``compact`` rewrites it
_META = "_meta.json"


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def _numbered(spark: SparkSession, root: str, kind: str) -> list[tuple[int, str]]:
    """(number, name) of the commits in a folder, in order."""
    return sorted((int(n.partition("=")[2]), n) for n in _names(spark, f"{root}/{kind}") if n.partition("=")[2].isdigit())


def _read_meta(spark: SparkSession, folder: str) -> dict:
    fs, p = _fs(spark, f"{folder}/{_META}")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def bucket_of(domain: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(domain), F.lit(buckets)).cast("int")


class LeadTable:
    """The table at ``root``; it is created with its first commit."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # --- commits

    def state(self) -> dict | None:
        """What the newest commit tells: seq, buckets, next_id, streams; null for a table without any."""
        newest = max([(n, f"{kind}/{name}") for kind in ("base", "delta") for n, name in _numbered(self.spark, self.root, kind)[-1:]], default=None)
        if newest is None:
            return None
        meta = _read_meta(self.spark, f"{self.root}/{newest[1]}")
        self.buckets = meta["buckets"]
        return meta

    def _publish(self, rows: DataFrame, name: str, meta: dict) -> None:
        """One rename makes the rows and their meta visible; an existing commit of this name raises. The next id
        is above every id that was given, here or before (``next_id`` of the meta)."""
        path, tmp = f"{self.root}/{name}={meta['seq']}", f"{self.root}/tmp/{uuid.uuid4().hex}"
        rows.write.partitionBy("bucket").parquet(tmp)
        top = self.spark.read.schema("id long").parquet(tmp).agg(F.max("id")).first()[0]
        meta = {**meta, "next_id": max(meta["next_id"], (top or 0) + 1)}
        fs, dst = _fs(self.spark, path)
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        out = fs.create(hadoop(f"{tmp}/{_META}"))
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        fs.mkdirs(dst.getParent())
        if fs.exists(dst) or not fs.rename(hadoop(tmp), dst):
            fs.delete(hadoop(tmp), True)
            raise FileExistsError(f"{path} was published by another writer; read the table again and retry")

    def _in_buckets(self, rows: DataFrame) -> DataFrame:
        """One task writes a bucket; a commit has at most one file for each bucket it touches."""
        return rows.withColumn("bucket", bucket_of(F.col("domain"), self.buckets)).repartition("bucket")

    def create(self, rows: DataFrame, next_id: int | None = None) -> None:
        """Commit 0: the whole table. ``next_id`` is the stored counter, else ids go on from the highest."""
        self._publish(self._in_buckets(rows.select(*S.STORED_LEAD.fieldNames())), "base/whole",
                      {"seq": 0, "buckets": self.buckets, "streams": {}, "next_id": next_id or 1})

    def replace(self, rows: DataFrame) -> None:
        """A commit with the whole table anew, as after deletions; streams and the id counter go on."""
        meta = self.state()
        self._publish(self._in_buckets(rows.select(*S.STORED_LEAD.fieldNames())), "base/whole", {**meta, "seq": meta["seq"] + 1})

    # --- reading

    def _buckets_in(self, folder: str) -> list[int]:
        return [int(x[7:]) for x in _names(self.spark, f"{self.root}/{folder}") if x.startswith("bucket=")]

    def _layout(self) -> tuple[dict[int, tuple[int, str | None]], list[tuple[int, str, list[int]]]]:
        """(number and folder of each bucket's base, folder null if it was empty; deltas with the buckets that need them)."""
        base: dict[int, tuple[int, str | None]] = dict.fromkeys(range(self.buckets), (-1, None))
        for n, name in _numbered(self.spark, self.root, "base"):
            if name.startswith("whole="):
                base = dict.fromkeys(range(self.buckets), (n, None))
            base.update(dict.fromkeys(self._buckets_in(f"base/{name}"), (n, f"base/{name}")))
        least, deltas = min(n for n, _ in base.values()), []
        for n, name in _numbered(self.spark, self.root, "delta"):
            if n > least and (held := [b for b in self._buckets_in(f"delta/{name}") if n > base[b][0]]):
                deltas.append((n, f"delta/{name}", held))
        return base, deltas

    def _rows(self, wanted: list[int] | None = None) -> DataFrame:
        """All rows that may count, with ``bucket`` and ``seq``; only of the wanted buckets."""
        base, deltas = self._layout()
        typed = StructType([*S.STORED_LEAD.fields, StructField("bucket", IntegerType())])
        parts = self.spark.createDataFrame([], typed).withColumn("seq", F.lit(0).cast("long"))
        folders: dict[tuple[int, str], list[int]] = {}
        for b, (n, folder) in base.items():
            if folder is not None:
                folders.setdefault((n, folder), []).append(b)
        folders.update({(n, folder): held for n, folder, held in deltas})
        for (n, folder), held in folders.items():
            at = [f"{self.root}/{folder}/bucket={b}" for b in held if wanted is None or b in wanted]
            if at:
                read = self.spark.read.schema(typed).option("basePath", f"{self.root}/{folder}").parquet(*at)
                parts = parts.unionByName(read.withColumn("seq", F.lit(n).cast("long")))
        return parts

    def read(self, wanted: list[int] | None = None) -> DataFrame:
        """The table: of every domain the row of its latest commit."""
        if self.state() is None:
            return self.spark.createDataFrame([], S.STORED_LEAD)
        return self._latest(self._rows(wanted)).select(*S.STORED_LEAD.fieldNames())

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        cols = [*S.STORED_LEAD.fieldNames(), "bucket"]
        return rows.groupBy("domain").agg(F.max_by(F.struct(*cols), "seq").alias("_r")).select("_r.*")

    # --- writing

    def merge(self, leads: DataFrame, run_id: int, now: str, stream: str | None = None, batch: int | None = None) -> bool:
        """Fold ``leads`` into the table by ``upsert_leads``; False if the batch of this stream was written before.

        Only the buckets that the leads fall into are read, only rows of their domains are joined, and
        only those are written. A commit that another writer published meanwhile raises, and the
        stream's checkpoint retries the batch."""
        meta = self.state()
        if meta is None:
            raise FileNotFoundError(f"no lead table at {self.root}: create() it first")
        if stream is not None and meta["streams"].get(stream, -1) >= batch:
            return False
        touched = [r.b for r in leads.select(bucket_of(F.col("domain"), self.buckets).alias("b")).distinct().collect()]  # at most BUCKETS
        if not touched:
            return True
        domains = leads.select("domain").distinct()
        current = self.read(touched).join(domains, "domain", "left_semi").checkpoint()
        changed = ST.upsert_leads(current, leads, run_id, now, next_id=meta["next_id"])
        streams = {**meta["streams"], **({stream: batch} if stream is not None else {})}
        self._publish(self._in_buckets(changed), "delta/seq", {**meta, "seq": meta["seq"] + 1, "streams": streams})
        return True

    def compact(self, after: int = COMPACT_AFTER) -> int:
        """Rewrite the buckets that have more than ``after`` deltas as base folders, once for each commit; returns
        their number. Readers of older folders go on undisturbed; ``vacuum`` removes what no bucket needs."""
        meta = self.state()
        if meta is None or (meta["seq"], f"seq={meta['seq']}") in _numbered(self.spark, self.root, "base"):
            return 0
        count: dict[int, int] = {}
        for _, _, held in self._layout()[1]:
            for b in held:
                count[b] = count.get(b, 0) + 1
        due = [b for b, k in count.items() if k > after]
        if due:
            self._publish(self._latest(self._rows(due)).repartition("bucket"), "base/seq", meta)
        return len(due)

    def vacuum(self) -> int:
        """Delete the folders that no bucket needs, but for the newest commit; returns their number."""
        base, deltas = self._layout()
        live = {folder for _, folder in base.values()} | {folder for _, folder, _ in deltas}
        newest = self.state()["seq"]
        fs, _ = _fs(self.spark, self.root)
        gone = []
        for kind in ("base", "delta"):
            numbered = _numbered(self.spark, self.root, kind)
            last_whole = max((n for n, name in numbered if name.startswith("whole=")), default=-1)
            gone += [f"{kind}/{name}" for n, name in numbered if f"{kind}/{name}" not in live and n not in (newest, last_whole)]
        for folder in gone:
            fs.delete(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}"), True)
        return len(gone)
