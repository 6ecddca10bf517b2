"""Spark session helpers: size-checked broadcast joins and tables in the shared run folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Small sides (polygons, scanline intervals, per-field statistics, centres) are written once
# and broadcast only if their files are at most this large (columnar and compressed: some ten
# times as much in memory at worst); beyond this they go through a shuffle join.
BROADCAST_MAX_BYTES = 16 << 20


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "fieldzones") -> SparkSession:
    """Session with AQE on and the UI off.  On a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor, its heap is the memory knob
            builder = builder.config("spark.driver.memory", os.environ.get("FZ_DRIVER_MEMORY", "16g"))
    builder = (builder
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each application: they may run
    without the driver's search path."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="fieldzones-code-"), "fieldzones_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, which a cluster has to set; only a
    ``local`` master, whose executors are the driver, gets a scratch folder without it."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="fieldzones-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


_RUNS: dict[str, str] = {}


def run_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, removed when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _RUNS:
        _RUNS[app] = f"{checkpoint_dir(spark).rstrip('/')}/fieldzones-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(release, spark)
    return _RUNS[app]


def release(spark: SparkSession) -> None:
    """Delete the run folder (its tables must not be read afterwards)."""
    sc = spark.sparkContext
    path = _RUNS.pop(sc.applicationId, None) if sc._jsc is not None else None
    if path is None:
        return
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the run folder and read it back.

    One evaluation (a reliable RDD checkpoint would compute an unpersisted plan twice), the
    lineage is cut, executor loss after this point only re-reads files, and the read-back
    carries real size statistics for later join planning.
    """
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """File bytes of a table that was just read back (the optimizer's own figure)."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a side that is expected, but not known, to be small.

    ``small`` is evaluated once, into a table whose size in bytes is then known: up to
    ``BROADCAST_MAX_BYTES`` it is broadcast and the big side is not shuffled, beyond that both
    sides are shuffled (and skewed keys split by adaptive execution).
    """
    small = cut_lineage(small)
    if stored_bytes(small) <= BROADCAST_MAX_BYTES:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


def parallelism(spark: SparkSession) -> int:
    """Number of tasks to spread generated rows over (all cores of the cluster)."""
    return max(int(spark.sparkContext.defaultParallelism), 1)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over all cores: for group functions whose work is not told by the bytes they
    read (adaptive execution would join their small partitions into one task)."""
    spark = df.sparkSession
    return df.repartition(max(parallelism(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
