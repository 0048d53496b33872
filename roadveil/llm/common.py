"""Shared helpers of the text operators: tables, the shared folder, staged tables."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is taken, but only for a local master:
    on a cluster a machine-local folder would lose rows with its machine.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", "") or context.getCheckpointDir()
    if folder:
        return folder
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def staged(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives
    the loss of executors, and gives later joins real sizes."""
    path = f"{shared_folder(spark).rstrip('/')}/roadveil/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """What runs inside sends at most so many rows at once to Python workers; afterwards the session is as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def ascii_lower(text):
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(*columns):
    """A deterministic number in [0, 1) of a row's columns, for bounded samples."""
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) / F.lit(1_000_003.0)


def raw_bytes(scalar) -> bytes:
    """UTF-8 bytes of an Arrow string scalar; null gives nothing."""
    return scalar.as_buffer().to_pybytes() if scalar.is_valid else b""


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
