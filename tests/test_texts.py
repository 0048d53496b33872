"""Links, labels and networks of a profile: cases that the supplied tables don't hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from roadveil.functions import text
from roadveil.operators import answers, extract, ingest


def test_links_in_any_order_and_what_they_do_not_say(spark):
    links = ["#r=52.5,13.4,-52.4999996,.5", "#p=bike&a=0&r=1,2,3,4", "#map=12/52.50001/-13.4&r=1.,2,3,4&a=7", "#r=1,2,3", "r=1,2,3,4", "#p=walk", None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(links)], "i long, link string")
    got = {r.i: r for r in rows.select("i", text.read_deep_link(F.col("link")).alias("r"), text.read_view(F.col("link")).alias("m")).collect()}
    assert tuple(got[0].r) == (52_500_000, 13_400_000, -52_500_000, 500_000, "walk", 15)
    assert tuple(got[1].r) == (1_000_000, 2_000_000, 3_000_000, 4_000_000, "bike", 0)
    assert tuple(got[2].r)[4:] == ("walk", 15) and tuple(got[2].m) == (12, 5_250_001, -1_340_000)
    assert all(got[i].r is None and got[i].m is None for i in (3, 4, 5, 6))


def test_labels(spark):
    rows = [("n", "s", "1", "t"), ("n", None, "1", "t"), (None, "s", None, ""), ("", None, None, "t"), (None, None, None, None)]
    found = spark.createDataFrame(rows, "n string, s string, h string, p string").select(text.place_label(*map(F.col, "nshp")).alias("l"))
    assert [r.l for r in found.collect()] == ["n, s 1, t", "n, t", "s", "t", ""]


def test_profiles_take_their_ways_and_walkers_go_back(spark):
    tags = "k long, u long, v long, highway string, area string, service string, foot string, bicycle string, oneway string"
    rows = [(1, 1, 2, "residential", None, None, None, None, "yes"), (2, 1, 2, "steps", None, None, None, None, None), (3, 1, 2, "path", "yes", None, None, None, None), (4, 1, 2, "path", None, "private", None, None, None), (5, 1, 2, "path", None, None, "no", None, "no"), (6, 1, 2, None, None, None, None, None, None), (7, 2, 3, "path", None, None, None, "no", None)]
    ways, nodes = spark.createDataFrame(rows, tags), spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (3, 3.0, 4.1)], "node_id long, x double, y double")
    arcs = lambda p: extract.within(nodes, extract.network(ways, p), 0.0, 0.0, 5.0)
    told = lambda p: sorted((r.k, r.u, r.back) for r in arcs(p)[1].collect())
    assert told("walk") == [(1, 1, 0), (1, 2, 1), (2, 1, 0), (2, 2, 1)] and told("bike") == [(1, 1, 0), (5, 1, 0), (5, 2, 1)]
    assert sorted(r.node_id for r in arcs("walk")[0].collect()) == [1, 2]


def test_equal_names_fill_a_search_in_order(spark):
    places = spark.createDataFrame([(i, "Alpha" if i % 3 else "alphabet", 0.0, 0.0) for i in range(40, 0, -1)], "place_id long, name string, x double, y double")
    asked = spark.createDataFrame([(1, "alpha"), (2, "ALPHA "), (3, "alphab"), (3, "alphab")], "search_id long, q string")
    got = [(r.search_id, r.rank, r.place_id) for r in ingest.address_hits(asked, places, (0.0, 0.0, 0.0, 0.0)).collect()]
    assert sorted(got) == sorted([(s, k + 1, p) for s in (1, 2) for k, p in enumerate((1, 2, 4, 5, 7))] + [(3, k + 1, 3 * k + 3) for k in range(5)] * 2)


def test_sound_requests_fail_without_a_street_or_a_way(spark):
    checks = spark.createDataFrame([(1, 200, 2), (2, 200, 1), (3, 200, 2), (4, 422, 0), (5, 503, 0), (6, 200, 1)], "req_id long, status long, n_routes long")
    snapped = spark.createDataFrame([(1, 10), (2, None), (3, 11), (4, None), (5, 10)], "req_id long, node_id long")
    found = answers.outcomes(checks, snapped, spark.createDataFrame([(10,), (12,)], "node_id long")).collect()
    assert sorted(map(tuple, found), key=lambda r: r[0]) == [(1, 200, None, 2), (2, 400, "far", 0), (3, 400, "apart", 0), (4, 422, None, 0), (5, 503, None, 0), (6, 400, "far", 0)]
