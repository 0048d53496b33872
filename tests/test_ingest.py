"""Map elements, outlines and address searches: cases that the supplied tables don't hold."""

from __future__ import annotations

from roadveil.operators import ingest
from roadveil.streaming import requests


def test_all_round_mounts_have_one_disc_and_bearings_a_cone_each(spark):
    rows = [("a", "0;90", "fixed"), ("b", "0;90", "dome"), ("c", None, None), ("d", "45-90;N", None), ("e", ";", "panning"), ("f", "0;0", None)]
    found = ingest.views(spark.createDataFrame(rows, "osm_id string, direction string, mount string")).collect()
    assert sorted((r.osm_id, r.view, r.bearing_dm) for r in found if r.view == "cone") == [("a", "cone", 0), ("a", "cone", 900), ("d", "cone", 0), ("f", "cone", 0), ("f", "cone", 0)]
    assert sorted(r.osm_id for r in found if r.view == "disc") == ["b", "c", "e"]


def test_rings_close_and_short_outlines_go(spark):
    rows = [(1, "way", n, float(n), 0.0) for n in range(4)] + [(2, "way", n, float(n % 4), 0.0) for n in range(5)] + [(3, "way", n, 0.0, 0.0) for n in range(3)] + [(4, "relation", n, float(n), 0.0) for n in range(6)]
    found = ingest.rings(spark.createDataFrame(rows, "bid long, type string, n int, x double, y double")).collect()
    assert sorted((r.bid, r.n, r.x) for r in found) == [(b, n, float(n % 4)) for b in (1, 2) for n in range(5)]


def test_searches_are_trimmed_and_need_three_letters(spark):
    places = spark.createDataFrame([(i, "Kenya" if i % 2 else None, float(i), 0.0) for i in range(20)], "place_id long, name string, x double, y double")
    asked = spark.createDataFrame([(1, " ke "), (2, " KEN "), (3, None), (4, "kenyan")], "search_id long, q string")
    found = ingest.address_hits(asked, places, (2.0, 0.0, 18.0, 0.0)).collect()
    assert sorted((r.search_id, r.rank, r.place_id) for r in found) == [(2, k + 1, 3 + 2 * k) for k in range(5)]


def test_an_answer_is_stale_once_a_newer_request_is_there(spark):
    rows = spark.sql("SELECT * FROM VALUES (1L, 1L, 0, 5), (2L, 1L, 5, 6), (3L, 1L, 5, 9), (4L, 2L, 0, 99) AS t(event_id, user_id, ts, answered)")
    assert {r.event_id: r.shown for r in requests.answered(rows).collect()} == {1: False, 2: False, 3: True, 4: True}
