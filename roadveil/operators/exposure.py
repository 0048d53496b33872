"""Exposure of edges to sensors' discs: clipped intervals, their union, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadveil.operators.grid import box_cells, near, point_cells

RADIUS = 25.0
CELL = 100.0


def disc_intervals(segments: DataFrame, sensors: DataFrame, radius: float = RADIUS) -> DataFrame:
    """``(k, u, v, seg, len, cam_id, t0, t1)``: the part of a segment inside a disc, as shares
    of its length. Circle and line meet where a quadratic vanishes; a tangent has no part."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    boxes = box_cells(segments, (F.least(x0, x1) - radius, F.least(y0, y1) - radius, F.greatest(x0, x1) + radius, F.greatest(y0, y1) + radius), CELL)
    points = point_cells(sensors.select("cam_id", F.col("x").alias("cx"), F.col("y").alias("cy")), "cx", "cy", CELL)
    dx, dy, fx, fy = x1 - x0, y1 - y0, x0 - F.col("cx"), y0 - F.col("cy")
    met = near(points, boxes, CELL).select("k", "u", "v", "seg", "cam_id", (dx * dx + dy * dy).alias("a"), (2 * (fx * dx + fy * dy)).alias("b"), (fx * fx + fy * fy - radius * radius).alias("c"))
    met = met.withColumn("d", F.col("b") * F.col("b") - 4 * F.col("a") * F.col("c")).filter("d >= 0 AND a > 0")
    root = F.sqrt("d")
    low, high = (-F.col("b") - root) / (2 * F.col("a")), (-F.col("b") + root) / (2 * F.col("a"))
    cut = met.select("k", "u", "v", "seg", F.sqrt("a").alias("len"), "cam_id", F.greatest(low, F.lit(0.0)).alias("t0"), F.least(high, F.lit(1.0)).alias("t1"))
    return cut.filter("t0 < t1")


def union_gain(intervals: DataFrame) -> DataFrame:
    """``gain``: what each interval adds to the union of those that start before it."""
    before = Window.partitionBy("k", "seg").orderBy("t0", "t1", "cam_id").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("t1").over(before), F.lit(0.0))
    return intervals.withColumn("gain", F.greatest(F.lit(0.0), F.col("t1") - F.greatest("t0", reached)))


def edge_exposure(segments: DataFrame, sensors: DataFrame) -> DataFrame:
    """``(k, u, v, exposure_mm, n_cameras)`` of the edges that some disc meets; whole
    millimetres an interval, so the sum does not depend on its order."""
    gains = union_gain(disc_intervals(segments, sensors))
    mm = F.floor(F.col("gain") * F.col("len") * 1000 + 0.5).cast("long")
    return gains.groupBy("k", "u", "v").agg(F.sum(mm).alias("exposure_mm"), F.countDistinct("cam_id").alias("n_cameras"))


def edge_cameras(segments: DataFrame, sensors: DataFrame) -> DataFrame:
    """``(k, cameras)``: sorted distinct sensors of an edge, comma-joined."""
    met = disc_intervals(segments, sensors).groupBy("k").agg(F.array_sort(F.collect_set("cam_id")).alias("ids"))
    return met.select("k", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("cameras"))


def exposure_intervals(segments: DataFrame, sensors: DataFrame) -> DataFrame:
    """Merged intervals of every segment, ends in hundred-thousandths of its length."""
    each = disc_intervals(segments, sensors)
    order = Window.partitionBy("k", "seg").orderBy("t0", "t1", "cam_id")
    start = F.when(F.col("t0") <= F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    island = F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0))
    merged = each.withColumn("first", start).withColumn("island", island).groupBy("k", "seg", "island").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    scaled = lambda c: F.floor(F.col(c) * 100000 + 0.5).cast("long")
    return merged.filter("t1 - t0 > 1e-6").select("k", "seg", scaled("t0").alias("t0_e5"), scaled("t1").alias("t1_e5"))


def coverage(lengths: DataFrame, exposed: DataFrame, cameras: DataFrame) -> DataFrame:
    """Network totals: length, exposure, exposed edges, distinct sensors, share in basis points."""
    left = lengths.agg(F.count("*").alias("n_edges"), F.sum("length_cm").alias("length_cm"))
    right = exposed.agg(F.coalesce(F.sum("exposure_mm"), F.lit(0)).alias("exposure_mm"), F.count("*").alias("n_exposed"))
    seen = cameras.agg(F.countDistinct("cam_id").alias("n_cameras"))
    share = F.when(F.col("length_cm") > 0, F.floor(F.col("exposure_mm") * 1000 / F.col("length_cm"))).otherwise(0).cast("long")
    return left.crossJoin(right).crossJoin(seen).withColumn("covered_bp", share)
