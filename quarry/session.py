"""Session helpers: a local session for tests/bench, the shared work folder,
and input spreading for single-file sources."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "quarry") -> SparkSession:
    """Local session used by tests and the bench (the driver builds its own)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Read from the session; only a local session without one gets its own
    folder (tests).  A cluster without the setting is an error: a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir()
    if not path:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path:
            sc.setCheckpointDir(path)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder before running quarry jobs")
        path = tempfile.mkdtemp(prefix="quarry-ckpt-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir() or path
    return path


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for a written table."""
    base = checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    return os.path.join(base, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a *scan* that arrives in fewer partitions than the cluster has cores.

    Each driver file holds a single row group, so its scan is one task.  Large
    inputs (many files / row groups) already arrive split and are left alone,
    so no extra shuffle is added at scale.  Call it on table reads only: asking
    a plan with exchanges for its partition count would run those exchanges.
    """
    if df.isStreaming:
        return df
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


#: Bytes of an Arrow batch sent to a Python worker (one longer row may exceed it).
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes, so that a worker's memory doesn't follow the rows of its partition.

    Spark's own cut is 10,000 rows or 64 MB.  The plan reads the setting when it
    runs, so it stays in the session; a session that sets its own keeps it.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_BYTES)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quarry`` importable on local Python workers (pandas UDFs are pickled by module) and bound their batches.

    Only for local masters; on a cluster the package is shipped the usual way
    (``--py-files`` / ``spark.submit.pyFiles`` or installed on the executors),
    so no machine-local file is involved.
    """
    import zipfile

    bound_batches(spark)
    sc = spark.sparkContext
    key = id(sc._jsc)
    if key in _SHIPPED or not sc.master.startswith("local"):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="quarry-pkg-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w") as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(key)
