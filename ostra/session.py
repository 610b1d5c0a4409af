"""Session helpers: everything a query may need from the running cluster."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in an Arrow batch of texts, and bytes, so that long texts come in smaller batches.
BATCH_ROWS, BATCH_BYTES = 512, 64 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
#: Bytes of a split of analysed documents: a task's postings take some twelve times as much, and stay in memory.
SPLIT_BYTES = 16 << 20


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset on one machine (a test) a
    folder of our own is made and set. On a cluster without it there is no folder to fall back to: an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="ostra-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, once an application.

    The driver serves it to the executors, which need no copy installed.
    """
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    _shipped.add(application)
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="ostra-ship-")) / "ostra_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(path))


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to those of this package; they are never raised."""
    for key, most in _LIMITS.items():
        now = spark.conf.get(key, None)
        if now is None or now.lstrip("-").isdigit() and not 0 < int(now) <= most:  # one with a unit is the user's own
            spark.conf.set(key, str(most))


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Scans that are run inside have splits of at most ``SPLIT_BYTES``, so that what a task shuffles needn't be spilled."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    least = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before)
    if least > SPLIT_BYTES:
        spark.conf.set(key, str(SPLIT_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, dealt out to all of them; any other as it is.

    Only a table of a few small files is ever moved; with more splits than cores there is no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def settle(df: DataFrame) -> DataFrame:
    """Run ``df`` once and cut its lineage with a reliable checkpoint.

    For narrow tables that several later jobs read: the text behind them is scanned only once,
    and the rows survive the loss of an executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled_rows(df: DataFrame) -> int:
    """The number of rows of a settled table, counted in one stage: an aggregation takes two and a plan."""
    return df._jdf.queryExecution().toRdd().count()


def local_session(app: str = "ostra", cpus: int | str | None = None) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("OSTRA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
