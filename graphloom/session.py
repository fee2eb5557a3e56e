"""Session defaults, checkpoint location, and size checks shared by the operators."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession, functions as F

# A side is broadcast only when its measured size stays under this many bytes.
BROADCAST_BYTES = 64 << 20
ARROW_ROWS = 1000


def build_session(app: str = "graphloom", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benches; a cluster passes its own session to every function."""
    b = (
        SparkSession.builder.appName(app).master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="graphloom-ckpt-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    return ship(b.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that their Python workers find it anywhere.

    Arrow batches count rows, and rows here hold whole texts: unless the session says otherwise they get fewer.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    if getattr(sc, "_graphloom_shipped", False):
        return spark
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), "graphloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(top):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("graphloom", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._graphloom_shipped = True
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; only a single local JVM may go without and gets a fresh one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="graphloom-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise an iteration's result in reliable storage so that a lost executor costs one iteration."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_broadcast(rows: int, bytes_per_row: int, limit: int = BROADCAST_BYTES) -> bool:
    return rows * bytes_per_row <= limit


def broadcast_if_small(df: DataFrame, bytes_per_row: int = 256) -> DataFrame:
    """``df`` marked for a broadcast join if its counted rows are few enough.

    For tables of one row per name: without statistics Spark would shuffle the other side by a handful of names.
    """
    return F.broadcast(df) if fits_broadcast(df.count(), bytes_per_row) else df


def ratio(num, den, empty=0.0):
    """``num / den`` with a fixed value when the denominator is zero."""
    num = F.col(num) if isinstance(num, str) else num
    den = F.col(den) if isinstance(den, str) else den
    return F.when(den == 0, F.lit(empty).cast("double")).otherwise(num.cast("double") / den)


def f1(p, r):
    p = F.col(p) if isinstance(p, str) else p
    r = F.col(r) if isinstance(r, str) else r
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r))
