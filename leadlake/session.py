"""SparkSession settings the library expects, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings that matter for correctness (UTC) and for scale (AQE, skew joins,
# broadcast threshold checked by the optimizer, Arrow for the few pandas paths).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # rows here are small but CPU-heavy (regexes, URL parsing): do not let AQE
    # merge small shuffle output into a handful of tasks
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Constraint propagation re-derives filters from every aliased expression;
    # with the wide regex/struct expressions here it grows combinatorially in
    # planning time and driver memory, while inferring nothing useful.
    "spark.sql.constraintPropagation.enabled": "false",
}

# Runtime SQL settings a job applies to whatever session it is handed.
RUNTIME_CONF = {
    # a key with many rows sends the sessions of each task to the shuffle, not its rows
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.constraintPropagation.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the library relies on to a given session."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def get_spark(master: str = "local[8]", app: str = "leadlake", shuffle_partitions: int = 8,
              extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session."""
    b = SparkSession.builder.master(master).appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the operator sets it to shared storage and we only read it. A
    folder is created here only when the session has none (local tests)."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="leadlake-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def work_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def table_exists(spark: SparkSession, path: str) -> bool:
    """A completely written Parquet folder (``_SUCCESS`` present) on any file system."""
    fs, _ = _fs(spark, path)
    return fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS"))


def publish_table(df, path: str, fmt: str = "parquet", marker: str | None = None) -> None:
    """Write to a temporary sibling folder, then rename into place, so readers
    never see a half-written table and a writer never clobbers one. If the target
    exists, or the rename fails, an error is raised: no write is lost unseen.
    ``marker`` is the name of an empty file that becomes visible with the data."""
    import uuid
    spark = df.sparkSession
    tmp = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex[:8]}"
    df.write.mode("overwrite").format(fmt).save(tmp)
    fs, dst = _fs(spark, path)
    _, src = _fs(spark, tmp)
    if marker is not None:
        fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{tmp}/_{marker}")).close()
    fs.mkdirs(dst.getParent())
    if fs.exists(dst) or not fs.rename(src, dst):
        fs.delete(src, True)
        raise FileExistsError(f"{path} exists or can't be created; nothing was published")
