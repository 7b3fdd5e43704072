"""Checkpoints: in the folder that spark.checkpoint.dir names. Where it is unset, in one of our own, if driver and executors are
one process; on a cluster, whose executors couldn't read each other's files there, an error."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def own_folder(spark) -> str:
    """A folder on this machine, for tests and single-machine sessions only."""
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="vigilframe-")


def ensure_checkpoints(spark) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or own_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: no lineage and no plan is left. (A checkpoint keeps how its rows are
    partitioned, an expression that grows with every round of a loop of joins.)"""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
