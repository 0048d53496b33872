"""The network of a profile, whole or around a point."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: kinds of ways that a profile doesn't take, and the tag that forbids it
CLOSED = ("abandoned", "bus_guideway", "construction", "corridor", "elevator", "escalator", "motorway", "motorway_link", "no", "planned", "platform", "proposed", "raceway", "razed", "rest_area", "services")
UNFIT = {"walk": CLOSED, "bike": (*CLOSED, "footway", "steps")}
FORBIDS = {"walk": "foot", "bike": "bicycle"}


def usable(profile: str) -> Column:
    """Whether a way is open to a profile: it has a kind, none that is unfit, is no area and nothing private, and the profile isn't forbidden."""
    absent = lambda name, value: F.coalesce(F.col(name) != value, F.lit(True))
    return F.coalesce(~F.col("highway").isin(*UNFIT[profile]), F.lit(False)) & absent("area", "yes") & absent("service", "private") & absent(FORBIDS[profile], "no")


def network(ways: DataFrame, profile: str) -> DataFrame:
    """``ways(k, u, v, highway, area, service, foot, bicycle, oneway, ...)`` -> ``(k, u, v, back)``: arcs of a profile. On foot all ways go both
    ways, a bicycle keeps to one-way streets; ``back`` is 1 where an arc goes against its way. A way is read once."""
    one_way = F.lit(False) if profile == "walk" else F.coalesce(F.col("oneway") == "yes", F.lit(False))
    arc = lambda u, v, back: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), F.lit(back).cast("long").alias("back"))
    there, back = arc("u", "v", 0), arc("v", "u", 1)
    each = ways.filter(usable(profile)).select("k", F.explode(F.when(one_way, F.array(there)).otherwise(F.array(there, back))).alias("a"))
    return each.select("k", "a.u", "a.v", "a.back")


def within(nodes: DataFrame, arcs: DataFrame, x: float, y: float, radius: float) -> tuple[DataFrame, DataFrame]:
    """Nodes not farther than ``radius`` from a point, and the arcs with both ends among them. The box around the circle is told apart, since a
    scan can use its bounds."""
    box = F.col("x").between(x - radius, x + radius) & F.col("y").between(y - radius, y + radius)
    dx, dy = F.col("x") - x, F.col("y") - y
    near = nodes.filter(box & (dx * dx + dy * dy <= radius * radius))
    ends = near.select(F.col("node_id").alias("end"))
    kept = arcs.join(ends, F.col("u") == F.col("end"), "left_semi").join(ends, F.col("v") == F.col("end"), "left_semi")
    return near, kept
