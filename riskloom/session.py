"""Session set-up and the shared folder that intermediate tables go to."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

_local_folder: str | None = None


def local_session(cores: int | str = "*", name: str = "riskloom", memory: str = "20g") -> SparkSession:
    """A single-machine session for tests and the bench; a cluster brings its own."""
    partitions = 8 if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def importable(spark: SparkSession) -> None:
    """Let this machine's Python workers import the package from where it lies.

    On a cluster the package is installed or shipped with the job, and that path is not there.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, *paths]))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local master, where all tasks run on this machine, may go without.
    """
    global _local_folder
    folder = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="riskloom-")
    return _local_folder


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Give iterative estimators a place to cut their lineage."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


_scopes: list[list[str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_folder(spark)}/riskloom/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table or file that `scratch_path` named."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[None]:
    """What is written on the way inside goes at the end: for work whose result is stored before that."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            remove(spark, path)


def freeze(df: DataFrame, label: str = "table") -> DataFrame:
    """Write `df` once and read it back.

    For a table that several passes read: they all see the same rows, nothing is
    computed twice, columns are pruned on reading, and a lost executor costs a
    re-read instead of a re-run of the whole plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
