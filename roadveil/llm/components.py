"""Connected components of an undirected edge table, as alternating star joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadveil.llm.common import staged


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of any comparable type -> ``(node, root)``, root the smallest node.

    Each round hangs every node on the smallest neighbour it knows (large star, then
    small star), so path lengths shrink geometrically. Only edge rows move: minima are
    pre-aggregated before the shuffle and the hub of a large star is an ordinary join
    key that adaptive execution may split. Nothing reaches the driver but two numbers.
    Null ends and loops are ignored; an empty table gives an empty table.
    """
    current = staged(
        spark,
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = staged(
            spark,
            both.filter(F.col("b") > F.col("a")).join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(),
            "large",
        )
        lower = large.filter(F.col("a") > F.col("b"))
        least = lower.groupBy("a").agg(F.min("b").alias("m"))
        small = lower.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b"))
        current = staged(
            spark,
            small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(),
            "small",
        )
        now = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components by fewer links: every node to the smallest of its component."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, root = flat[: len(a)], flat[len(a) :], np.arange(len(names))
    while True:
        low = np.minimum(root[a], root[b])
        was = root.copy()
        for end in (root[a], root[b], a, b):
            np.minimum.at(root, end, low)
        root = root[root]
        if (root == was).all():
            break
    far = root != np.arange(len(names))
    return names[far], names[root[far]]
