"""Session construction and the few session-level settings the library needs."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "creditlens") -> SparkSession:
    """A local session for tests and the bench; on a cluster use the cluster's own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CREDITLENS_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    The deployment names a folder that the driver and all executors share. Only
    where the key is unset and the master is local (tests) does the session get
    a folder of its own; it is registered with the SparkContext either way, so
    ``checkpoint()`` and the ML estimators' ``checkpointInterval`` use it.
    """
    own = spark.sparkContext.getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and own:
        path = own.rsplit("/", 1)[0]
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="creditlens-")
    if own is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


_FOLDERS: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder (for saved models / tables).

    All of them lie in one folder of the application, which ``release`` deletes; that
    happens by itself when the driver's process ends."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/creditlens/{spark.sparkContext.applicationId}"
    if not _FOLDERS:
        atexit.register(release)
    _FOLDERS.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex[:12]}"


def release() -> None:
    """Deletes all tables and models that this process has written to shared scratch folders."""
    while _FOLDERS:
        fs, place = pafs.FileSystem.from_uri(_FOLDERS.pop())
        if fs.get_file_info(place).type == pafs.FileType.Directory:
            fs.delete_dir(place)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: computed once
    whatever reads it, and a lost executor costs a reread of files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
