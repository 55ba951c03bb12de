"""Cutting lineage in the folder that all executors share, and using all cores for a table in few splits."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and Spark runs on this machine alone."""
    context = spark.sparkContext
    here = context.getCheckpointDir()
    if here is None:
        here = spark.conf.get("spark.checkpoint.dir", None)
        if here is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            here = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(here)
    return here


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and read from there: a lost executor costs no earlier stage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a plain scan; one with fewer splits than the session has cores is dealt out to all of them, before costly work on its texts."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
