"""Where intermediate tables go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
_local_folder: list[str] = []
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; a temporary one in local mode only."""
    folder = spark.conf.get(SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {SETTING} to a folder that all executors share")
    if not _local_folder:
        _local_folder.append(tempfile.mkdtemp(prefix="corpusforge-"))
        atexit.register(shutil.rmtree, _local_folder[0], ignore_errors=True)
    return _local_folder[0]


def materialize(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write a table that several steps use to the shared folder and go on from there.

    The lineage ends here, lost executors cost nothing already computed, and because Spark knows the
    size of the written files it broadcasts them only when they are below its own threshold. ``codec`` is for
    tables worth another compression than the session's.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the tables that :func:`materialize` wrote in this process; results read from them end here.

    Call it when a job's results are stored. Returns how many were deleted.
    """
    count = 0
    while _written:
        place = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        count += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
    return count
