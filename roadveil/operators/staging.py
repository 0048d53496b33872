"""Tables written to the folder that all executors share, so that lineage ends there and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors reach. Unset, a temporary folder is taken for a local master alone."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def staged(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """``df``, written below the shared folder and read back."""
    path = f"{shared_folder(spark)}/roadveil/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
