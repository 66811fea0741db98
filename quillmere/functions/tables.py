"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN = "quillmere-stages"
_FOLDERS: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # at the driver's end the session may be gone
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. A local session without one (tests) gets a temporary one once; a cluster without one is refused."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not (sc.master + "[").startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quillmere-"))
        named = sc.getCheckpointDir()
    folder = f"{named.rstrip('/')}/{_OWN}-{sc.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_delete, spark, folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back: its lineage ends there, and it is computed once.

    What isn't dropped before stays as long as results that read it may be used: to the driver's end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


@contextlib.contextmanager
def dealt_by_fewer_keys(spark: SparkSession):
    """Joins that run herein leave sides that are both dealt by some of their keys, in the same way, where they are (Spark deals them anew by all keys unless told)."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared one, for tables that are written in parts; it goes at the driver's end."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def drop_staged(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    path = getattr(df, "_staged_path", None)
    if path:
        _delete(df.sparkSession, path)
