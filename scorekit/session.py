"""Session construction and lineage-cutting helpers.

Intermediate results that must be read more than once with identical content
(sorted positions, small statistics tables) are written as Parquet tables under
the cluster's ``spark.checkpoint.dir``.  The directory is read from the
session; only a local-mode session without one gets a private folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(
    app: str = "scorekit",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict | None = None,
) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for materialised intermediates.

    Uses the session's checkpoint directory (``spark.checkpoint.dir``).  A
    private temporary folder is created only for local-mode sessions that have
    none configured (tests); on a cluster a missing setting is an error, since a
    machine-local folder would not be visible to other executors.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # no driver-side context (e.g. a remote session): use the conf only
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not conf_dir:
            raise RuntimeError("spark.checkpoint.dir is not set")
        return conf_dir.rstrip("/")
    root = sc.getCheckpointDir()
    if not root:
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if conf_dir:
            sc.setCheckpointDir(conf_dir)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="scorekit-ckpt-"))
        else:
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/...) visible to all executors"
            )
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, label: str = "tmp", compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint root and read it back.

    This cuts the lineage (a lost executor re-reads files instead of
    recomputing a non-deterministic sort) and gives later reads column pruning.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path, compression=compression)
    out = spark.read.parquet(path)
    out._scratch_path = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote and nothing reads any more (for jobs
    that go on for long, such as streams)."""
    for df in stored:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_dir(spark: SparkSession) -> str:
    """Per-application folder for materialised intermediates (under the checkpoint dir)."""
    return f"{checkpoint_root(spark)}/scorekit/{session_key(spark)}"


def release_intermediates(spark: SparkSession) -> None:
    """Delete this application's materialised intermediates.

    Call once every result that depends on them has been written; DataFrames
    built before the call must not be used afterwards."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        fs.delete(path, True)
    from .sources import bindings
    bindings.forget_stored(spark)


def join_stored(big: DataFrame, small: DataFrame, on, how: str = "inner",
                label: str = "side") -> DataFrame:
    """Join ``big`` with a derived table that is written once first.

    No hint is given: the written table's size in bytes is known when the join is
    planned, so Spark broadcasts it below ``autoBroadcastJoinThreshold`` and
    otherwise shuffles (splitting skewed partitions at run time)."""
    return big.join(materialize(small, label), on, how)


def with_scalars(df: DataFrame, stats: DataFrame, name: str = "_g") -> DataFrame:
    """Attach the single row of ``stats`` to every row of ``df`` as struct ``name``.

    One scalar subquery (run once, its value broadcast with the plan) instead
    of a cross join; the struct is projected once, so later references to
    ``name.field`` do not re-plan the subquery."""
    return df.withColumn(name, stats.select(F.struct(*stats.columns)).scalar())


def session_key(spark: SparkSession) -> str:
    """Identifier of the running application (keys per-session caches)."""
    try:
        return spark.sparkContext.applicationId
    except Exception:
        return spark.conf.get("spark.app.id", "app")


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``scorekit`` importable in Python workers (what ``--py-files`` does).

    Operators that run Python on executors (``mapInPandas``) call this once
    per application: the package is
    zipped into the scratch folder (or a driver temp folder when the scratch
    folder is not on a local filesystem) and added with ``addPyFile``, which
    ships it to every executor."""
    import zipfile

    key = session_key(spark)
    if key in _SHIPPED:
        return
    try:
        sc = spark.sparkContext
    except Exception:  # remote sessions ship artifacts their own way
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = scratch_dir(spark)
    local = root[len("file:"):] if root.startswith("file:") else root
    if "://" in local:
        local = tempfile.mkdtemp(prefix="scorekit-pkg-")
    os.makedirs(local, exist_ok=True)
    target = os.path.join(local, f"scorekit-{uuid.uuid4().hex}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirnames, filenames in os.walk(pkg):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for fn in filenames:
                if fn.endswith(".py"):
                    full = os.path.join(dirpath, fn)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(target)
    _SHIPPED.add(key)
