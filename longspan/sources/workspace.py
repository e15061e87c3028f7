"""A folder for files that queries write: the shared one of the session; on one machine, where none is set, a temporary one."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return f"{shared}/work-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="work-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` read back from files of its own, for plans that read it more than once; a lost executor costs no recomputation.

    The files go when the driver ends.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}-{name}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.parquet(path)
