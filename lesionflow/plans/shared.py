"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a local temporary one in local mode (tests), an error on a cluster."""
    java = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and java.getCheckpointDir().isDefined():
        found = java.getCheckpointDir().get()
    if found is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-lesionflow-", dir="/tmp")
    if java.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stash(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Writes the rows as Parquet into the shared folder and reads them back: lineage ends here, the
    plan that follows knows the size, and a lost executor costs only its own tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint for small tables inside loops; Spark removes it when nothing refers to it."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
