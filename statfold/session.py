"""Session helpers: builder defaults, the shared checkpoint folder, scratch paths."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest table (rows) broadcast when its size is only known after counting.
BROADCAST_MAX_ROWS = 1_000_000


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "statfold") -> SparkSession:
    """A session with the settings every operator here assumes.

    AQE is on (coalesces small shuffles, splits skewed join partitions at run
    time), the time zone is UTC, and Arrow carries pandas batches.
    """
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.appName(app_name)
        .master(master or f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 2 * cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("STATFOLD_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``statfold`` importable in Python workers (Arrow UDFs, ``mapInPandas``).

    The package is zipped once per application and added with ``addPyFile``,
    which distributes it to every executor of the cluster.
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="statfold-pkg-"), "statfold.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as zf:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    zf.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, taking it from the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is (a cluster without one is refused). Only a local master with
    nothing configured (unit tests, a laptop) falls back to a private
    temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # a machine-local folder is not visible to other executors and dies with the machine
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="statfold-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/statfold-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back.

    One job computes and writes the rows (an RDD checkpoint computes them
    twice unless they are cached); the copy is columnar and compressed, and a
    lost executor afterwards only costs a re-read, never a recomputation that
    could renumber rows.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int | None = None) -> DataFrame:
    """``broadcast(df)`` when ``df`` has at most ``max_rows`` rows, else ``df`` unchanged.

    For tables whose size grows with the number of groups (per-group
    quantiles, group starts): the rows are counted (stopping one past the
    bound), and a larger table goes to a shuffle join, which AQE may still
    convert or split for skew at run time. ``spark.statfold.broadcastMaxRows``
    overrides the bound.
    """
    if max_rows is None:
        max_rows = int(df.sparkSession.conf.get("spark.statfold.broadcastMaxRows", str(BROADCAST_MAX_ROWS)))
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
