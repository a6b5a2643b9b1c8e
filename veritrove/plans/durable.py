"""Intermediate results that outlive the executors that made them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only a purely local session, as in tests, gets a folder of its own when the
    setting is absent; a cluster without the setting is refused, since a
    machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = context.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _OWN.get(context.applicationId)
        if not folder:
            folder = _OWN[context.applicationId] = tempfile.mkdtemp(prefix="veritrove-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, which ``release`` deletes."""
    path = f"{shared_folder(spark)}/veritrove-{uuid.uuid4().hex}"
    application = spark.sparkContext.applicationId
    if application not in _WRITTEN:
        _WRITTEN[application] = []
        atexit.register(_release_at_exit, spark)
    _WRITTEN[application].append(path)
    return path


def _release_at_exit(spark: SparkSession) -> None:
    """What nobody has released goes with the driver, if its session still runs."""
    try:
        release(spark)
    except Exception:  # the session is gone, and the folder is its owner's
        pass


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so that several consumers cost one computation and a lost
    executor costs a read. Partitions are read as they were written.
    """
    spark = df.sparkSession
    path = fresh_folder(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete what this session has ``stored``, once the results that read it are written; how many tables."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        found = spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)
    return len(paths)
