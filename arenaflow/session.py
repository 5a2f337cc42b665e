"""Session helpers: reliable checkpoints in the folder shared by the cluster."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where it is unset (tests), the warehouse, which a cluster shares as well.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    active = named or spark.sparkContext.getCheckpointDir()
    return active or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one run's intermediate table inside the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_once(frame: DataFrame, label: str) -> DataFrame:
    """Write ``frame`` below the shared folder and read it again: columns are pruned and filters pushed when it is reused."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def cut_lineage(frame: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``frame`` through a reliable checkpoint."""
    spark = frame.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint(eager)
