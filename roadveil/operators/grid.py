"""Range joins as equi-joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def point_cells(df: DataFrame, x: str, y: str, size: float) -> DataFrame:
    """One row a point, with its cell ``gx, gy``."""
    return df.withColumns({"gx": cell(F.col(x), size), "gy": cell(F.col(y), size)})


def box_cells(df: DataFrame, box: tuple[Column, Column, Column, Column], size: float) -> DataFrame:
    """One row for every cell that the box (least x, least y, most x, most y) touches."""
    x0, y0, x1, y1 = box
    wide = df.withColumn("gx", F.explode(F.sequence(cell(x0, size), cell(x1, size))))
    return wide.withColumn("gy", F.explode(F.sequence(cell(y0, size), cell(y1, size))))


def near(points: DataFrame, boxes: DataFrame, size: float, how: str = "inner") -> DataFrame:
    """Pairs that share a cell. A point has one cell, so no pair comes twice; a crowded cell
    is an ordinary join key that adaptive execution may split."""
    return boxes.join(points, ["gx", "gy"], how)
