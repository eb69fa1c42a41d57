"""Folders for written tables that every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; in local sessions that name none, below a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, with its lineage cut."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir") or folder(df.sparkSession))
    return df.checkpoint()


def released(spark: SparkSession) -> None:
    """Have Spark's cleaner remove the shuffle files that no DataFrame in use refers to: it learns of them when the driver's JVM
    collects its garbage, which may be long after the disks are full. Spark holds on to its last job, so that is a small one."""
    spark.range(1).count()
    spark.sparkContext._jvm.System.gc()
