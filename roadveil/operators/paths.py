"""What lies along routes: their steps, the sensors that see them, the pieces in view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadveil.operators.exposure import disc_intervals, exposure_intervals


def steps(paths: DataFrame) -> DataFrame:
    """``paths(req_id, path)`` -> ``(req_id, step, u, v)``, steps from 1; a path of one node has none."""
    pair = "transform(sequence(1, size(path) - 1), i -> struct(cast(i AS long) AS step, path[i - 1] AS u, path[i] AS v))"
    return paths.filter("size(path) > 1").select("req_id", F.explode(F.expr(pair)).alias("s")).select("req_id", "s.step", "s.u", "s.v")


def tracks(paths: DataFrame, positions: DataFrame) -> DataFrame:
    """``positions(node_id, lat, lon)`` -> ``(req_id, points)``: a route's positions in order."""
    each = paths.select("req_id", F.posexplode("path").alias("n", "node_id")).join(positions, "node_id")
    points = F.array_sort(F.collect_list(F.struct("n", "lat", "lon")))
    return each.groupBy("req_id").agg(points.alias("points"))


def step_edges(paths: DataFrame, best: DataFrame) -> DataFrame:
    """``best(u, v, k)``, the edge taken between two nodes -> ``(req_id, step, k)``."""
    return steps(paths).join(best, ["u", "v"]).select("req_id", "step", "k")


def sensors_seen(paths: DataFrame, best: DataFrame, segments: DataFrame, sensors: DataFrame) -> DataFrame:
    """``(req_id, n_cameras)``: distinct sensors whose disc a route enters; none gives 0.

    Pairs of edge and sensor are made distinct before they meet the routes, and pairs of route and sensor
    before they are counted, so that edges near many sensors don't multiply.
    """
    seen = disc_intervals(segments, sensors).select("k", "cam_id").distinct()
    pairs = step_edges(paths, best).select("req_id", "k").distinct().join(seen, "k").select("req_id", "cam_id").distinct()
    counts = pairs.groupBy("req_id").agg(F.count("*").alias("n_cameras"))
    return paths.filter("path IS NOT NULL").select("req_id").join(counts, "req_id", "left").select("req_id", F.coalesce("n_cameras", F.lit(0)).alias("n_cameras"))


def pieces_in_view(paths: DataFrame, best: DataFrame, segments: DataFrame, sensors: DataFrame) -> DataFrame:
    """``(req_id, from_mm, to_mm)``: stretches of a route in view, measured along it; stretches
    that meet at a joint are one. A window holds one route's segments."""
    length = F.floor(F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0"))) * 1000 + 0.5).cast("long")
    walked = step_edges(paths, best).join(segments.select("k", "seg", length.alias("mm")), "k")
    behind = Window.partitionBy("req_id").orderBy("step", "seg").rowsBetween(Window.unboundedPreceding, -1)
    walked = walked.withColumn("past", F.coalesce(F.sum("mm").over(behind), F.lit(0)))
    at = lambda c: (F.col("past") + F.floor(F.col(c) * F.col("mm") / 100000 + 0.5)).cast("long")
    parts = walked.join(exposure_intervals(segments, sensors), ["k", "seg"]).select("req_id", at("t0_e5").alias("a"), at("t1_e5").alias("b"))
    order = Window.partitionBy("req_id").orderBy("a", "b")
    starts = F.when(F.col("a") <= F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    islands = parts.withColumn("starts", starts).withColumn("island", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("req_id", "island").agg(F.min("a").alias("from_mm"), F.max("b").alias("to_mm")).drop("island")


def oriented(line: Column, start: Column, end: Column) -> Column:
    """A line's points in the direction of travel: turned if its last point is nearer to the start than its first; without a line, the chord."""
    square = lambda p: (p["x"] - start["x"]) * (p["x"] - start["x"]) + (p["y"] - start["y"]) * (p["y"] - start["y"])
    turned = F.when(square(line[0]) > square(F.element_at(line, -1)), F.reverse(line)).otherwise(line)
    return F.when(F.size(line) > 1, turned).otherwise(F.array(start, end))


def assembled(paths: DataFrame, best: DataFrame, lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """One record a route: ``(req_id, length_cm, exposure_dm, points array<struct<x, y>>)``.

    ``best(u, v, k, length_cm, exposure_dm)``: the edge taken between two nodes; ``lines(k, points)``, in either direction, for the edges that
    have one; ``nodes(node_id, x, y)``. Edges' lines follow each other in order, each without the point that it shares with the one before. A
    route between a node and itself is that node twice; no path, no record.
    """
    place = nodes.select("node_id", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("p"))
    walked = steps(paths).join(best.select("u", "v", "k", "length_cm", "exposure_dm"), ["u", "v"]).join(lines, "k", "left")
    walked = walked.join(place.toDF("u", "start"), "u").join(place.toDF("v", "end"), "v")
    each = walked.withColumn("points", oriented(F.col("points"), F.col("start"), F.col("end")))
    part = F.when(F.col("step") == 1, F.col("points")).otherwise(F.slice("points", 2, F.size("points")))
    whole = each.withColumn("part", F.struct("step", part.alias("points"))).groupBy("req_id").agg(F.sum("length_cm").alias("length_cm"), F.sum("exposure_dm").alias("exposure_dm"), F.array_sort(F.collect_list("part")).alias("parts"))
    whole = whole.select("req_id", "length_cm", "exposure_dm", F.flatten(F.transform("parts", lambda p: p["points"])).alias("points"))
    still = paths.filter("size(path) = 1").select("req_id", F.col("path")[0].alias("node_id")).join(place, "node_id")
    zero = F.lit(0).cast("long")
    return whole.unionByName(still.select("req_id", zero.alias("length_cm"), zero.alias("exposure_dm"), F.array("p", "p").alias("points")))


def bounds(points: Column) -> dict[str, Column]:
    """The least and the greatest of both coordinates."""
    each = {"x": F.transform(points, lambda p: p["x"]), "y": F.transform(points, lambda p: p["y"])}
    return {f"{c}_{n}": f(each[c]) for c in each for n, f in (("min", F.array_min), ("max", F.array_max))}


def steps_in_view(segments: DataFrame, sensors: DataFrame) -> DataFrame:
    """``segments(node, k, seg, x0, y0, x1, y1, ..)`` of the edges that lead to nodes -> ``(node, mm, view array<struct<a, b>>)``: an edge's length and
    its stretches in view, measured along it."""
    length = F.floor(F.sqrt((F.col("x1") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y1") - F.col("y0")) * (F.col("y1") - F.col("y0"))) * 1000 + 0.5).cast("long")
    behind = Window.partitionBy("node").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    walked = segments.select("node", "k", "seg", length.alias("mm")).withColumn("past", F.coalesce(F.sum("mm").over(behind), F.lit(0)))
    at = lambda c: (F.col("past") + F.floor(F.col(c) * F.col("mm") / 100000 + 0.5)).cast("long")
    pair = F.when(F.col("t0_e5").isNotNull(), F.struct(at("t0_e5").alias("a"), at("t1_e5").alias("b")))
    whole = walked.join(exposure_intervals(segments, sensors), ["k", "seg"], "left").withColumn("pair", pair)
    return whole.groupBy("node").agg(F.max(F.col("past") + F.col("mm")).alias("mm"), F.array_sort(F.collect_list("pair")).alias("view"))


def steps_in_lines(tree: DataFrame, taken: DataFrame, lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """``taken(node, before, k, length_cm, exposure_dm)``, ``lines`` and ``nodes`` as for ``assembled`` -> what a step adds to a route's line, by the node it leads to: ``text``,
    ``box`` and ``n``, the points without the first, ``first`` and ``first_box`` with it, in whole millimetres; ``still`` and ``still_box`` for the root, that node twice."""
    place = nodes.select("node_id", F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("p"))
    each = taken.join(lines, "k", "left").join(place.toDF("before", "start"), "before").join(place.toDF("node", "end"), "node")
    mm = lambda c: F.floor(c * 1000 + 0.5).cast("long")
    whole = lambda points: F.transform(points, lambda p: F.struct(mm(p["x"]).alias("x"), mm(p["y"]).alias("y")))
    text = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ",")
    box = lambda c: F.array(*bounds(F.col(c)).values())
    each = each.withColumn("all", whole(oriented(F.col("points"), F.col("start"), F.col("end")))).withColumn("rest", F.slice("all", 2, F.size("all")))
    steps_ = each.select("node", "length_cm", "exposure_dm", text(F.col("rest")).alias("text"), box("rest").alias("box"), F.size("rest").cast("long").alias("n"), text(F.col("all")).alias("first"), box("all").alias("first_box"))
    root = tree.filter("before IS NULL").select("node").join(place.toDF("node", "p"), "node").select("node", whole(F.array("p", "p")).alias("all"))
    return steps_.unionByName(root.select("node", text(F.col("all")).alias("still"), box("all").alias("still_box")), allowMissingColumns=True)
