"""Session settings for local work; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cores: str = "*", name: str = "quillmere", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with adaptive plans on and times in UTC."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Bytes of one Arrow batch to a Python worker, where the session names no limit: rows may be long texts.
ARROW_BYTES = 4 << 20
_ARROW_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once a context, unless PYTHONPATH says that they have it; bounds Arrow batches by bytes."""
    import atexit
    import os
    import shutil
    import tempfile
    from pathlib import Path

    if not spark.sparkContext.getConf().contains(_ARROW_LIMIT):
        spark.conf.set(_ARROW_LIMIT, str(ARROW_BYTES))
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_quillmere_sent", False):
        return spark
    folder = tempfile.mkdtemp(prefix="quillmere-ship-")  # the driver serves the file as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.addPyFile(shutil.make_archive(f"{folder}/quillmere", "zip", root, "quillmere"))
    sc._quillmere_sent = True
    return spark
