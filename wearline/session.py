"""SparkSession construction and cluster-shared paths."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  ANSI stays on (Spark's default): divide by
# zero and bad casts fail loudly, so the operators use try_divide / try_cast.
# Settings that are given already (spark-submit, defaults file) are kept.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
LOCAL_CONF = {
    # local mode: the driver JVM is the only executor
    "spark.driver.memory": "8g",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.shuffle.partitions": "8",
}


def get_session(master: str | None = None, app: str = "wearline", **conf: str) -> SparkSession:
    """Return (or create) a session with the library's base settings.

    On a cluster ``master`` and everything it was submitted with are left
    alone, shuffle partitions included; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    local = LOCAL_CONF if master and master.startswith("local") else {}
    for key, value in {**local, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for key, value in BASE_CONF.items():
        if key not in conf and not given.contains(key):
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and materialised intermediates.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local master,
    where driver and executors are one process, gets an invented one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="wearline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint dir for a written intermediate."""
    return os.path.join(checkpoint_dir(spark), name)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint dir and read it back.

    Used where one intermediate feeds several branches (threshold, reference,
    scoring): the lineage is cut once, the read-back has file statistics for
    AQE, and a lost executor costs a re-read instead of a recomputation.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``wearline`` importable in Python workers (once per application).

    Operators that run Python on executors (isolation-forest growth and
    scoring, streaming state) pickle references to this package.  The package
    is zipped and distributed with ``addPyFile`` - the in-process equivalent
    of ``spark-submit --py-files``.
    """
    import zipfile

    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    fd, path = tempfile.mkstemp(prefix="wearline-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
