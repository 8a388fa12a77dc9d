"""Session factory."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "lithospark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ANSI mode stays as Spark sets it.

    Checkpoints go once nothing refers to them. Keyword settings use ``__`` for
    dots: ``spark__sql__shuffle__partitions="8"``.
    """
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the cluster names it in ``spark.checkpoint.dir``.

    Where none is named, a local master (tests, a laptop) gets a new local one;
    a cluster gets an error, as its machines share no local folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lithospark-checkpoint-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder whose files go when the application ends."""
    made = new_folder(spark, name)
    at = spark._jvm.org.apache.hadoop.fs.Path(made)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return f"{made}/files"


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any file or folder has a path like this."""
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of any executor; once an application."""
    sc = spark.sparkContext
    if getattr(sc, "_lithospark_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lithospark-"), "lithospark"), "zip", root, "lithospark"))
    sc._lithospark_shipped = True
