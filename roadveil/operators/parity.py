"""Two ways of finding routes, held against each other over a sample of cases."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadveil.operators import overlay
from roadveil.operators.staging import shared_folder

CASES = "req_id long, source long, target long, alpha long"
RESULTS = "req_id long, alpha long, cost_cm long"
TOLERANCE = 2e-3


def sampled(nodes: DataFrame, alphas: DataFrame, count: int = 25, seed: str = "1") -> DataFrame:
    """``(req_id, source, target, alpha)``: ``count`` pairs of nodes at most, each with every alpha. The nodes of the smallest hashes are drawn, so
    the same whatever the partitions; a second hash gives the targets."""

    def drawn(salt: str, name: str) -> DataFrame:
        hashed = F.md5(F.concat_ws("/", F.lit(salt), F.lit(seed), F.col("node_id").cast("string")))
        least = nodes.select("node_id", hashed.alias("h")).orderBy("h", "node_id").limit(count)
        return least.select(F.col("node_id").alias(name), F.row_number().over(Window.orderBy("h", "node_id")).cast("long").alias("n"))

    pairs = drawn("from", "source").join(drawn("to", "target"), "n")
    place = F.row_number().over(Window.partitionBy("n").orderBy("alpha")) - 1
    every = pairs.crossJoin(F.broadcast(alphas.select(F.col("alpha").cast("long").alias("alpha"))))  # a fixed list of alphas
    return every.select((F.col("n") * 100 + place).cast("long").alias("req_id"), "source", "target", "alpha")


def through_lines(spark: SparkSession, rows: DataFrame, schema: str, tag: str) -> DataFrame:
    """``rows`` written as a JSON object a line and read back."""
    path = f"{shared_folder(spark)}/roadveil/{tag}-{uuid.uuid4().hex}"
    rows.write.json(path)
    return spark.read.schema(schema).json(path)


def compared(cases: DataFrame, one: DataFrame, other: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``(req_id, source, target, alpha, cost_cm, other_cm, same)``; no path is the same as no path only."""
    both = cases.join(one.select("req_id", "alpha", "cost_cm"), ["req_id", "alpha"], "left").join(other.select("req_id", "alpha", F.col("cost_cm").alias("other_cm")), ["req_id", "alpha"], "left")
    near: Column = F.abs(F.col("cost_cm") - F.col("other_cm")) <= tolerance * F.greatest("cost_cm", F.lit(1))
    same = F.when(F.col("cost_cm").isNull() | F.col("other_cm").isNull(), F.col("cost_cm").isNull() & F.col("other_cm").isNull()).otherwise(near)
    return both.select("req_id", "source", "target", "alpha", "cost_cm", "other_cm", same.alias("same"))


def report(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("n_cases"), F.count("cost_cm").alias("n_reached"), F.count_if(~F.col("same")).alias("n_failed"))


def checked(spark: SparkSession, nodes: DataFrame, arcs: DataFrame, alphas: DataFrame, size: float = overlay.TILE, count: int = 25) -> DataFrame:
    """The sample's cases through a file of lines, searched by heaps and by sweeps, the second's answers through a file too."""
    cases = through_lines(spark, sampled(nodes, alphas, count), CASES, "cases")
    one = overlay.Overlay(spark, cases, arcs, nodes, size).costs()
    other = through_lines(spark, overlay.Overlay(spark, cases, arcs, nodes, 2 * size, kind=overlay.Sweeps).costs(), RESULTS, "answers")
    return compared(cases, one, other)
