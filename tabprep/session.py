"""Session settings this library is tuned for, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of a job go when it ends, not when the driver happens to collect its garbage.
FREE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_LOCAL_SCRATCH: dict[str, str] = {}
_SCOPE = threading.local()


def build_session(master: str | None = None, app: str = "tabprep", **conf: str) -> SparkSession:
    """A session with adaptive execution on; shuffle width is left to the cluster unless given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local master, where driver and executors share one disk, may fall back to a folder of
    its own; on a cluster a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tabprep-")
        atexit.register(shutil.rmtree, _LOCAL_SCRATCH[app], ignore_errors=True)
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below this application's own part of the shared folder."""
    return f"{shared_dir(spark)}/tabprep-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application stored; call it when no result is needed any more."""
    _delete(spark, f"{shared_dir(spark)}/tabprep-{spark.sparkContext.applicationId}")


def materialize_counted(df: DataFrame, label: str = "stage") -> tuple[DataFrame, int]:
    """``materialize`` that also tells the number of rows, counted while they are written."""
    watch = Observation()
    stored = materialize(df.observe(watch, F.count(F.lit(1)).alias("rows")), label)
    return stored, watch.get["rows"]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What ``materialize`` stores inside is deleted at the end; results must have been written by then."""
    outer, _SCOPE.paths = getattr(_SCOPE, "paths", None), []
    try:
        yield
    finally:
        for path in _SCOPE.paths:
            _delete(spark, path)
        _SCOPE.paths = outer


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings for what is started inside; what they were before is restored."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored_bytes(df: DataFrame) -> int:
    """Size of the files behind a table as ``materialize`` returns it, as the planner knows it."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends there, a lost executor costs no recomputation, and the planner sees the true
    size of the table, so it broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if getattr(_SCOPE, "paths", None) is not None:
        _SCOPE.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
