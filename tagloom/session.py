"""Spark session and shared-folder helpers."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins from runtime sizes (this is what
# size-checks every non-fixed broadcast), splits skewed shuffle partitions and
# coalesces small ones.  The UI is a server and stays off.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "tagloom",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    ``master`` is only set for local runs; on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", "16g")
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised tables.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset a session with a
    local master, whose one process is every executor, gets a fresh private folder; any other
    session raises, because a folder that only one machine sees loses the tables.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tagloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique sub-folder of the shared checkpoint folder."""
    return os.path.join(checkpoint_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


#: Bytes and rows of an Arrow batch that a Python step of a table written ``bounded`` holds.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20, "spark.sql.execution.arrow.maxRecordsPerBatch": 2000}


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Inside, Python steps that are planned get batches of at most ``BATCH``, or of the session's own smaller setting."""
    kept = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k, most in BATCH.items():
            own = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(kept[k]))
            spark.conf.set(k, str(min(own, most) if own > 0 else most))
        yield
    finally:
        for k, own in kept.items():
            spark.conf.set(k, own)


def materialize(df, name: str, bounded: bool = False):
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts lineage (executor loss recomputes from the table, not from the corpus) and
    lets several actions reuse one fitted model instead of refitting it.  With ``bounded``
    its Python steps hold ``BATCH`` at a time, whatever the session's batches are.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark) if bounded else contextlib.nullcontext():
        df.write.mode("overwrite").parquet(path)
    remove_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


_TABLES: list[tuple[SparkSession, str]] = []


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Materialised tables belong to this process: they go when it ends."""
    if not _TABLES:
        atexit.register(remove_tables)
    _TABLES.append((spark, path))


def remove_tables() -> None:
    """Remove every table ``materialize`` wrote and that is not removed yet."""
    while _TABLES:
        spark, path = _TABLES.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:                     # the session has ended before us: nothing to ask
            return
