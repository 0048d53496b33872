"""Hand-computed answers and properties of the network operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadveil.functions import features, projection, simplify, tags
from roadveil.operators import answers, exposure, graph, linear, parity, paths, routes, zones
from roadveil.streaming import requests as streams


def test_directions(spark):
    rows = [(None, []), ("N", [0.0]), ("nnw", [337.5]), ("90", [90.0]), ("450", [90.0]), ("-10", [350.0]), ("0;90", [0.0, 90.0]), ("N; 180", [0.0, 180.0]), ("45-90", []), ("45-90;N", [0.0]), ("", []), (";", []), ("12D", []), ("nan", [])]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(rows)], "i int, v string")
    got = {r[0]: r[1] for r in df.select("i", tags.directions(F.col("v"))).collect()}
    assert [got[i] for i in range(len(rows))] == [d for _, d in rows]


def test_sensors_kept(spark):
    cases = [(None, None, True), ("indoor", None, False), (None, "camera;ALPR", True), ("public", " camera ", True), (None, "Camera", False), (None, "", False), (None, "guard", False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, k string, want boolean")
    assert df.filter(tags.is_sensor(F.col("s"), F.col("k")) != F.col("want")).count() == 0


def segments(spark, rows):
    return spark.createDataFrame(rows, "k long, u long, v long, seg int, x0 double, y0 double, x1 double, y1 double")


def sensors(spark, rows):
    return spark.createDataFrame(rows, "cam_id long, x double, y double, bearing double")


def test_disc_exposure_is_of_the_union(spark):
    line = segments(spark, [(1, 0, 1, 1, 0.0, 0.0, 100.0, 0.0)])
    one = sensors(spark, [(1, 50.0, 0.0, None)])
    twice = sensors(spark, [(1, 50.0, 0.0, None), (2, 60.0, 0.0, None)])
    assert exposure.edge_exposure(line, one).collect()[0]["exposure_mm"] == 5_000
    got = exposure.edge_exposure(line, twice).collect()[0]
    assert got["exposure_mm"] == 60_000 and got["n_cameras"] == 2
    touching = sensors(spark, [(1, 50.0, 25.0, None)])
    assert exposure.edge_exposure(line, touching).count() == 0
    assert exposure.edge_exposure(segments(spark, []), one).count() == 0


def test_rays_stop_at_walls(spark):
    cam = sensors(spark, [(1, 0.0, 0.0, 0.0), (2, 500.0, 500.0, None)])
    wall = spark.createDataFrame([(1, 1, -50.0, 20.0, 50.0, 20.0)], "bid long, wall int, px double, py double, qx double, qy double")
    got = {(r[0], r[1]): r[2] for r in zones.ray_hits(cam, wall).collect()}
    assert len(got) == 29 + 120
    assert got[1, 14] == 20_000  # straight ahead
    assert got[1, 0] == round(20_000 / math.cos(math.radians(35)))
    assert set(v for (c, _), v in got.items() if c == 2) == {25_000}


def test_pareto_keeps_optimal_costs(spark):
    rows = [(1, 2, k, length, exp) for k, (length, exp) in enumerate([(100, 50), (100, 50), (120, 40), (130, 40), (140, 10), (200, 30)])]
    costs = spark.createDataFrame(rows, "u long, v long, k long, length_cm long, exposure_dm long")
    kept = [r["k"] for r in graph.pareto(costs).orderBy("k").collect()]
    assert kept == [0, 2, 4]
    for alpha in (0, 1, 5, 1000):
        cost = lambda r: r[3] + 10 * alpha * r[4]  # noqa: B023, E731
        assert min(map(cost, rows)) == min(cost(r) for r in rows if r[2] in kept)


def city(spark, n=150):
    """Nodes along a street, two a tile of 20 metres."""
    return spark.createDataFrame([(i, 10.0 * i, 0.0) for i in range(n)], "node_id long, x double, y double")


@pytest.mark.parametrize("size", [20.0, 45.0, 8000.0])
def test_routes_over_tiles_agree_with_one_search(spark, size):
    import random

    rng = random.Random(2)
    rows = [(u, v, rng.randint(1, 9)) for u in range(60) for v in (u + 1, u - 1, rng.randrange(60), (u + 7) % 60) if 0 <= v < 58]
    best = {}
    for u, v, c in rows:
        best[u, v] = min(c, best.get((u, v), 99))

    def plain(source):
        cost, before = {source: 0}, {}
        for _ in range(60):
            for (u, v), c in best.items():
                if u in cost and cost[u] + c < cost.get(v, 10**9):
                    cost[v] = cost[u] + c
        for (u, v), c in best.items():
            if v != source and u in cost and cost[u] + c == cost[v]:
                before[v] = min(u, before.get(v, 10**9))
        return cost, before

    asked = [(100 * s + t, s, t) for s in (0, 31, 59) for t in range(0, 60, 4)]
    found = {r.req_id: (r.cost_cm, r.path) for r in routes.route_paths(spark, spark.createDataFrame(asked, "req_id long, source long, target long"), spark.createDataFrame(rows, "u long, v long, cost long"), city(spark, 60), size).collect()}
    for i, s, t in asked:
        cost, before = plain(s)
        path = [t] if t in cost else None
        while path and path[0] in before:
            path.insert(0, before[path[0]])
        assert found[i] == (cost.get(t), path)


def test_snap_limit_and_ties(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0)], "node_id long, x double, y double")
    points = spark.createDataFrame([(1, 5.0, 0.0), (2, 9.0, 0.0), (3, 510.0, 0.0), (4, 510.5, 0.0)], "req_id long, x double, y double")
    got = {r[0]: (r[1], r[2]) for r in routes.snap(points, nodes).collect()}
    assert got == {1: (1, 5000), 2: (2, 1000), 3: (2, 500_000), 4: (None, None)}


def test_stream_gives_the_batch_rows(spark, tmp_path):
    query = streams.latest_stream(spark, "/root/testdata/sf0.001", str(tmp_path))
    query.awaitTermination(120)
    want = streams.latest(spark.read.parquet("/root/testdata/sf0.001/events.parquet")).collect()
    assert sorted(map(tuple, spark.table("latest_requests").collect())) == sorted(map(tuple, want))


def test_projection_meets_known_arcs(spark):
    """Equator to 45 degrees and to the pole along the meridian, and the edge of a zone at the equator."""
    rows = spark.createDataFrame([(1, 45.0, 15.0), (2, 89.99999999, 15.0), (3, 0.0, 18.0), (4, None, 15.0), (5, 52.5, 13.4)], "id int, lat double, lon double")
    x, y = projection.to_metres(F.col("lat"), F.col("lon"), 33)
    there = rows.select("id", "lat", "lon", x.alias("x"), y.alias("y"))
    lat, lon = projection.to_degrees(F.col("x"), F.col("y"), 33)
    found = {r.id: r for r in there.withColumns({"lat2": lat, "lon2": lon}).collect()}
    assert abs(found[1].x - 500000) < 1e-3 and abs(found[1].y - 0.9996 * 4984944.378) < 2e-3
    assert abs(found[2].y - 0.9996 * 10001965.729) < 3e-3
    assert abs(found[3].x - 833978.557) < 2e-3 and abs(found[3].y) < 1e-3
    assert found[4].x is None and found[4].lat2 is None
    assert abs(found[5].lat2 - 52.5) < 1e-10 and abs(found[5].lon2 - 13.4) < 1e-10


def test_paths_take_smallest_nodes_and_keep_unreached(spark):
    arcs = spark.createDataFrame([(1, 2, 5), (1, 3, 5), (2, 4, 5), (3, 4, 5), (4, 5, 1), (6, 1, 1)], "u long, v long, cost long")
    asked = spark.createDataFrame([(10, 1, 5), (11, 1, 6), (12, 1, 1), (13, 9, 1), (14, 1, None)], "req_id long, source long, target long")
    found = {r.req_id: (r.cost_cm, r.path) for r in routes.route_paths(spark, asked, arcs, city(spark, 7), 20.0).collect()}
    assert found == {10: (11, [1, 2, 4, 5]), 11: (None, None), 12: (0, [1]), 13: (None, None), 14: (None, None)}
    walked = paths.steps(routes.route_paths(spark, asked, arcs, city(spark, 7)))
    assert sorted(map(tuple, walked.collect())) == [(10, 1, 1, 2), (10, 2, 2, 4), (10, 3, 4, 5)]
    assert paths.steps(routes.route_paths(spark, asked.limit(0), arcs, city(spark, 7))).count() == 0


def test_point_feature_leaves_out_nulls_and_reads_back(spark):
    rows = spark.createDataFrame([(1.5, 2.0, "a", None), (0.0, -1.0, None, 'q"')], "x double, y double, a string, b string")
    made = rows.select(features.point_feature(F.col("x"), F.col("y"), {"a": F.col("a"), "b": F.col("b")}).alias("t"))
    back = [r.f for r in made.select(features.read_point(F.col("t")).alias("f")).collect()]
    assert [(f.geometry.coordinates, f.properties) for f in back] == [([1.5, 2.0], {"a": "a"}), ([0.0, -1.0], {"b": 'q"'})]
    assert spark.createDataFrame([("no",)], "t string").select(features.read_point(F.col("t")).alias("f")).first().f.geometry is None


def test_stored_geometry_of_loops_and_bends(spark):
    edges = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0, 20.0, 0.0), (2, 0.0, 0.0, 10.0, 6.0, 20.0, 0.0), (3, 0.0, 0.0, 0.0, 4.0, 0.0, 0.0), (4, 0.0, 0.0, 40.0, 0.0, 80.0, 0.0), (5, 0.0, 0.0, 30.0, 0.0, 20.0, 0.0)], "k int, ax double, ay double, mx double, my double, bx double, by_ double")
    found = {r.k: (r.bend_mm, r.stored) for r in graph.stored_geometry(edges).collect()}
    assert found == {1: (0, False), 2: (6000, True), 3: (4000, False), 4: (0, True), 5: (10000, True)}


def test_request_status_and_verdicts(spark):
    rows = [(1, 52.0, 13.0, None, None, 200, 2), (2, 52.0, 13.0, "bike", 0.0, 200, 1), (3, 91.0, 13.0, "boat", 5.0, 422, 0), (4, None, 13.0, "walk", 5.0, 422, 0), (5, -90.0, 180.0, "boat", 1000.0, 503, 0), (6, 0.0, 0.0, "walk", 1000.5, 422, 0)]
    asked = spark.createDataFrame(rows, "req_id int, lat double, lon double, profile string, alpha double, status long, n long")
    found = {r.req_id: (r.status, r.n_routes) for r in answers.checked(asked).collect()}
    assert found == {r[0]: r[-2:] for r in rows}
    cases = [(0, False, 5, 0, "seen"), (0, True, 0, 0, "clear"), (15, True, 5, 5, "least"), (15, False, 5, 0, "unseen"), (15, False, 5, 2, "detour")]
    told = spark.createDataFrame(cases, "alpha int, same boolean, a int, b int, want string")
    assert told.filter(answers.verdict(F.col("alpha"), F.col("same"), F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_search_towards_a_target_leaves_the_rest_alone(spark):
    """Of a town of 3,600 corners a search for a near target works off few, and one across the town those about its way."""
    side = 60
    nodes = spark.createDataFrame([(i, float(i % side) * 100, float(i // side) * 100) for i in range(side * side)], "node_id long, x double, y double")
    arcs = spark.createDataFrame([(i, i + d, 10_000 + (i * 7919 + d) % 900, 0) for i in range(side * side) for d, ok in ((1, i % side < side - 1), (-1, i % side > 0), (side, i // side < side - 1), (-side, i // side > 0)) if ok], "u long, v long, length long, exposure long")
    for source, target, most in ((1830, 1833, 40), (605, 645, 900)):
        asked = spark.createDataFrame([(1, source, target, 0)], "req_id long, source long, target long, alpha long")
        for size in (1e6, 2000.0):
            found = routes.Search(spark, asked, arcs, nodes, size)
            assert found.costs().first()["cost_cm"] >= abs(source - target) % side * 10_000
            assert 0 < found.settled() <= most * (1 if size == 1e6 else 3)


def test_places_along_lines(spark):
    """Shares of segments as shares of their line, joined across corners; slices with the corners inside; specks and points are none."""
    rows = [(1, 1, 0.0, 0.0, 30.0, 0.0), (1, 2, 30.0, 0.0, 30.0, 40.0), (1, 3, 30.0, 40.0, 0.0, 40.0), (2, 1, 5.0, 5.0, 5.0, 5.0), (3, 1, 0.0, 0.0, 100.0, 0.0)]
    segments = spark.createDataFrame(rows, "k long, seg int, x0 double, y0 double, x1 double, y1 double")
    parts = spark.createDataFrame([(1, 1, 0.5, 1.0), (1, 2, 0.0, 0.25), (1, 3, 0.5, 0.5), (1, 3, 0.9, 1.0), (2, 1, 0.0, 1.0), (3, 1, 0.1, 0.2), (3, 1, 0.15, 0.4), (3, 1, 0.7, 0.7)], "k long, seg int, t0 double, t1 double")
    found = linear.merged(linear.on_lines(parts, segments).select("k", "a", "b"))
    assert sorted(tuple(r) for r in found.collect()) == [(1, 1, 15_000, 40_000), (1, 2, 97_000, 100_000), (3, 1, 10_000, 40_000)]
    lines = {(r["k"], r["n"]): [tuple(p) for p in r["points"]] for r in linear.slices(found, segments).collect()}
    assert lines == {(1, 1): [(15_000, 0), (30_000, 0), (30_000, 10_000)], (1, 2): [(3_000, 40_000), (0, 40_000)], (3, 1): [(10_000, 0), (40_000, 0)]}
    assert linear.slices(found.limit(0), segments).count() == 0


def split(points, tolerance):
    """Corners that stay, by recursion over segments."""
    def away(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy))) if dx or dy else 0
        return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)

    far = [away(p, points[0], points[-1]) for p in points[1:-1]]
    if not far or max(far) <= tolerance:
        return [points[0], points[-1]] if len(points) > 1 else points
    k = far.index(max(far)) + 1
    return split(points[: k + 1], tolerance)[:-1] + split(points[k:], tolerance)


def test_simplified_lines_and_rings(spark):
    rng = random.Random(6)
    lines = {i: [(int(x), int(40 * math.sin(x / 60)) + rng.randint(-4, 4)) for x in range(0, rng.choice([1, 20, 700]), 7)] for i in range(12)}
    around = [(int(1000 * math.cos(j / 50 * math.pi)), int(1000 * math.sin(j / 50 * math.pi))) for j in range(100)]
    lines |= {20: [*around, around[0]], 21: [(0, 0), (500, 1), (1000, 0), (500, -1), (0, 0)], 22: [(5, 5)] * 6, 23: None, 24: []}
    table = spark.createDataFrame([(i, None if p is None else [{"x": x, "y": y} for x, y in p]) for i, p in lines.items()], "k long, points array<struct<x:long,y:long>>")
    found = {r["k"]: None if r["p"] is None else [tuple(p) for p in r["p"]] for r in table.select("k", simplify.simplified("points", 9.0).alias("p")).collect()}
    assert all(found[i] == split(lines[i], 9.0) for i in range(12))
    across = max(range(100), key=lambda j: (math.hypot(around[j][0] - 1000, around[j][1]), -j))
    assert found[20] == split(lines[20][: across + 1], 9.0)[:-1] + split(lines[20][across:], 9.0) and 10 < len(found[20]) < 60
    assert len(found[21]) == 4 and found[21][0] == found[21][-1]  # a ring keeps three corners
    assert found[22] == [(5, 5)] * 2 and found[23] is None and found[24] == []
    long = simplify.kept_corners(np.arange(5_000.0), np.where(np.arange(5_000) % 2, 9.0, -9.0) * np.linspace(1, 2, 5_000), 1.0)
    assert len(long) == 5_000  # every corner a split, and no recursion


def test_bend_of_any_line(spark):
    rng = random.Random(9)
    lines = [[(rng.random() * 100, rng.random() * 100) for _ in range(n)] for n in (2, 3, 8, 40)] + [[(1.0, 1.0), (4.0, 5.0), (1.0, 1.0)], [(1.0, 1.0)]]
    table = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in p]) for i, p in enumerate(lines)], "k long, points array<struct<x:double,y:double>>")
    for r in table.select("k", graph.bend(F.col("points")).alias("b"), graph.length_of(F.col("points")).alias("m")).collect():
        p = lines[r["k"]]
        a, b = np.array(p[0]), np.array(p[-1])
        chord = [a + (b - a) * s for s in np.linspace(0, 1, 4001)]
        assert abs(max(min(math.dist(q, c) for c in chord) for q in p) - r["b"]) < 0.05
        assert abs(sum(math.dist(p[i], p[i + 1]) for i in range(len(p) - 1)) - r["m"]) < 1e-9


def test_routes_are_put_together(spark):
    """Lines turned into the direction of travel, chords where there is none, no joint twice, one node twice, no path no record."""
    nodes = spark.createDataFrame([(i, float(10 * i), 0.0) for i in range(4)], "node_id long, x double, y double")
    best = spark.createDataFrame([(0, 1, 7, 100, 1), (1, 2, 8, 200, 2), (2, 3, 9, 300, 3)], "u long, v long, k long, length_cm long, exposure_dm long")
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    lines = spark.createDataFrame([(7, line((10, 0), (5, 5), (0, 0))), (8, line((10, 0), (15, 5), (16, 6), (20, 0)))], "k long, points array<struct<x:double,y:double>>")
    asked = spark.createDataFrame([(1, [0, 1, 2, 3]), (2, [2]), (3, None), (4, [2, 3])], "req_id long, path array<long>")
    found = {r["req_id"]: (r["length_cm"], r["exposure_dm"], [tuple(p) for p in r["points"]]) for r in paths.assembled(asked, best, lines, nodes).collect()}
    assert found == {1: (600, 6, [(0, 0), (5, 5), (10, 0), (15, 5), (16, 6), (20, 0), (30, 0)]), 2: (0, 0, [(20, 0), (20, 0)]), 4: (300, 3, [(20, 0), (30, 0)])}


def test_heat_of_every_zoom(spark):
    rows = [(10.0, 10.0, 3), (40.0, 20.0, 1), (-30.0, 5.0, 2), (290.0, 10.0, 5), (295.0, 10.0, 0), (5000.0, 0.0, 9)]
    got = {(r["zoom"], r["gx"], r["gy"]): (r["intensity"], r["x_mm"], r["y_mm"]) for r in graph.heat(spark.createDataFrame(rows, "x double, y double, w int"), (0.0, 0.0, 100.0, 100.0), 50.0, 2, 1).collect()}
    assert got == {(2, 0, 0): (4096, 17_500, 12_500), (2, -1, 0): (4096, -30_000, 5_000), (1, 0, 0): (4096, 17_500, 12_500), (1, -1, 0): (4096, -30_000, 5_000), (1, 2, 0): (4096, 290_000, 10_000), (0, 0, 0): (4096, 17_500, 12_500), (0, -1, 0): (2048, -30_000, 5_000), (0, 1, 0): (4096, 290_000, 10_000)}


def test_parity_tells_a_planted_error(spark):
    side = 12
    nodes = spark.createDataFrame([(i, float(i % side) * 100, float(i // side) * 100) for i in range(side * side)], "node_id long, x double, y double")
    rows = [(i, i + d, 10_000 + (i * 7919 + d) % 900, (i * 31 + d) % 70) for i in range(side * side) for d, ok in ((1, i % side < side - 1), (-1, i % side > 2), (side, i // side < side - 2), (-side, i // side > 0)) if ok]
    arcs, alphas = spark.createDataFrame(rows, "u long, v long, length long, exposure long"), spark.createDataFrame([(0,), (15,)], "alpha int")
    found = parity.checked(spark, nodes, arcs, alphas, 400.0, 10).cache()
    assert tuple(parity.report(found).first())[::2] == (20, 0) and found.filter("cost_cm IS NULL").count() > 0
    one = found.select("req_id", "alpha", "cost_cm")
    wrong = one.withColumn("cost_cm", F.when((F.col("req_id") == one.filter("cost_cm > 5000").agg(F.min("req_id")).first()[0]), F.col("cost_cm") * 1.01).otherwise(F.col("cost_cm")).cast("long"))
    cases = found.select("req_id", "source", "target", "alpha")
    assert parity.report(parity.compared(cases, one, wrong)).first()["n_failed"] == 1
    lost = one.withColumn("cost_cm", F.when(F.col("req_id") != 100, F.col("cost_cm")))
    assert parity.report(parity.compared(cases, one, lost)).first()["n_failed"] == one.filter("req_id = 100 AND cost_cm IS NOT NULL").count()
