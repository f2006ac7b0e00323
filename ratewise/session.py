"""Spark session and shared-storage helpers.

The library never assumes a machine-local scratch folder: anything it writes
(lineage cuts, materialised views, result tables) goes under the directory
the cluster names in ``spark.checkpoint.dir``. Without that setting a local
master gets a folder under the system temp dir; any other master is an error.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings a job of this library expects. AQE re-plans joins and coalesces
# shuffle partitions at runtime from real sizes; skew-join splits a hot key's
# partition; the broadcast threshold is Spark's own size check (estimated
# statistics, then runtime statistics under AQE) for joins we do not hint.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # HotSpot never compiles a method of more than 8,000 bytes: larger generated ones
    # are left out, and their operators run as several compiled ones (``compiled_plans``).
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Let HotSpot JIT-compile the large whole-stage-codegen methods of wide
    # projections (the booking derivation); without it they run interpreted.
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}


def get_spark(master: str | None = None, app: str = "ratewise",
              shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compiled_plans(spark: SparkSession) -> None:
    """Sets Spark's limit for generated methods to HotSpot's (see ``DEFAULT_CONF``) in a
    session that someone else made, unless its limit is already lower."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > int(DEFAULT_CONF[name]):
        spark.conf.set(name, DEFAULT_CONF[name])


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and written tables.

    Read from the session (``SparkContext.getCheckpointDir`` or the
    ``spark.checkpoint.dir`` setting); set one under the temp dir only when
    neither exists, which happens in tests only.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = sc.master or ""
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="ratewise-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/ratewise/{name}-{uuid.uuid4().hex[:12]}"


def local_path(p: str) -> str:
    """Strip a ``file:`` scheme for code that lists files with os APIs."""
    return p[len("file:"):] if p.startswith("file:") else p


def exists(spark: SparkSession, path: str) -> bool:
    """Path probe through Hadoop's FileSystem, so it works for any scheme."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


_CLEANING = threading.Lock()
_CLEANERS: dict = {}        # session -> (threads inside ``shuffles_removed``, the setting before)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries planned inside remove their shuffle files when they end.

    Spark otherwise keeps them until the driver's garbage collection meets their plan, so the
    shuffles of all steps of a query lie on disk at once. Meant for writes, which plan
    anew each time; a result that is asked for again makes its shuffles again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    key = id(spark._jsparkSession)
    with _CLEANING:
        inside, before = _CLEANERS.get(key) or (0, spark.conf.get(name, "false"))
        _CLEANERS[key] = (inside + 1, before)
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        with _CLEANING:
            inside, before = _CLEANERS[key]
            if inside > 1:
                _CLEANERS[key] = (inside - 1, before)
            else:
                del _CLEANERS[key]
                spark.conf.set(name, before)


def cut_lineage(df):
    """Reliable lineage cut: write ``df`` as a Parquet table under the shared
    checkpoint folder and scan it back.

    Computes the plan once (``Dataset.checkpoint`` runs it twice unless the
    data is also cached), and the later passes read only the columns they
    need with real size statistics for the optimizer. A lost executor re-reads
    written files instead of recomputing the joins. The plan's shuffle files
    go as soon as the table is written. Never a machine-local
    folder, never ``localCheckpoint``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "cut")
    with shuffles_removed(spark):
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ratewise`` importable in Python workers (``addPyFile`` of a zip,
    the in-session equivalent of ``--py-files``). Needed only by operators
    that run Python on executors (pandas UDFs); done once per application."""
    import os
    import zipfile
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="ratewise-pyfiles-"), "ratewise.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


__all__ = ["get_spark", "checkpoint_dir", "scratch_path", "local_path", "exists", "cut_lineage",
           "ship_package", "shuffles_removed", "compiled_plans", "DEFAULT_CONF"]
