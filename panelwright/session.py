"""Session helpers: where shared files go and how lineage is cut."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("panelwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_LOCAL: list[str] = []
_SETTLED: list[str] = []


def _is_local(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the cluster.

    A session on one machine (master ``local[...]``) that names none gets a
    temporary folder, which is removed when the process ends.  On a cluster a
    missing setting is an error: parts written to local disks would be lost.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not _is_local(spark):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="panelwright-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder; ``release`` removes it."""
    path = f"{shared_dir(spark)}/panelwright/{tag}-{uuid.uuid4().hex}"
    _SETTLED.append(path)
    return path


def settled() -> int:
    """How many tables this process has settled and not yet removed."""
    return len(_SETTLED)


def release(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Remove every table that this process has settled; returns their number.

    To be called when the results built on them have been written.  ``since``
    keeps that many of the oldest (see :func:`scope`), ``keep`` of the latest.
    """
    n, latest = 0, _SETTLED[max(since, len(_SETTLED) - keep):]
    del _SETTLED[len(_SETTLED) - len(latest):]
    while len(_SETTLED) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_SETTLED.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _SETTLED.extend(latest)
    return n


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove what is settled inside the block when it ends, and nothing else.

    Results must be written to a path of their own before the end.  Blocks may be
    nested; threads of one process should not share one.
    """
    since = len(_SETTLED)
    try:
        yield
    finally:
        release(spark, since)


def drop_leftovers(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and broadcasts of queries that are over.

    It does so when the driver collects its garbage, which rounds of small jobs
    rarely make it do: meanwhile disks, executors and the driver fill up.
    """
    gc.collect()
    spark._jvm.System.gc()


def settle(df: DataFrame, tag: str = "table", files: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    The scan has no lineage to recompute when executors are lost, and its exact
    file size lets Catalyst broadcast it only when it is below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffle it otherwise.  It is
    used for tables that several jobs read; ``files`` shuffles a table that is
    small by construction (one row per day) into that many files, after the
    aggregation that made it small has run in parallel.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    (df.repartition(files) if files else df).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
