"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

# Settings every job in the library assumes: UTC session clock, AQE with skew
# handling, Arrow for the few pandas paths, no UI server.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "flowwarden",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    # session-level settings also apply when the session already existed
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``flowwarden`` importable in the Python workers (pandas-backed
    operators pickle references to its functions): zip the package once per
    SparkContext and add it with ``addPyFile``, which also ships it to every
    executor of a cluster."""
    sc = spark.sparkContext
    if getattr(sc, "_flowwarden_shipped", False):
        return
    import zipfile
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="flowwarden-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._flowwarden_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this must be set by the deployment (a shared file system).
    Only a local-mode session without it (tests, the bench) gets a private
    scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="flowwarden-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(path)
    return path


#: Folders of the innermost ``scratch``.
_scratch: ContextVar[list | None] = ContextVar("scratch", default=None)


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Shuffle files go when the query that wrote them has ended; else they stay on the
#: executors until the driver's JVM collects garbage, those of all steps together.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def scratch():
    """Rows that ``cut_lineage`` keeps inside are deleted at the end, shuffle files at
    the end of their query. What is read after it must be ``settled``, or cut as
    ``lasting``."""
    kept: list = []
    token = _scratch.set(kept)
    spark = SparkSession.getActiveSession()
    before = spark.conf.get(SHUFFLE_CLEANUP, "false") if spark else None
    if spark:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        _scratch.reset(token)
        if spark:
            spark.conf.set(SHUFFLE_CLEANUP, before)
        for session, path in kept:
            delete_path(session, path)


def _cut(df: DataFrame, kept: list | None) -> DataFrame:
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if kept is None:
        return df.checkpoint(eager=True)
    path = os.path.join(folder, "scratch", uuid.uuid4().hex)
    kept.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame, lasting: bool = False) -> DataFrame:
    """Rows kept in the shared checkpoint folder (never local): a reliable checkpoint,
    within ``scratch`` Parquet files that end with it (smaller, and read by column)."""
    return _cut(df, None if lasting else _scratch.get())


def settled(build: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``build()``, kept as ``cut_lineage`` does where this is called; what
    ``build`` itself kept is deleted."""
    outer = _scratch.get()
    with scratch():
        return _cut(build(), outer)
