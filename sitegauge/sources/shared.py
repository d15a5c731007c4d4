"""The folder that all executors share, for tables between two parts of a job."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one the session names in ``spark.checkpoint.dir``, removed when the driver ends.

    Where none is set, a session of one process (as in tests) gets a temporary one; a cluster must name one, since
    a folder of one machine would hide rows from the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="sitegauge-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/sitegauge-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: later passes read only the columns they need, and a
    lost executor costs no recomputation. Its size is known to the planner, which so broadcasts small ones only."""
    folder = f"{shared_folder(df.sparkSession)}/rows"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
