"""Collections of features: what is read is what json reads, wherever the parts are cut."""

from __future__ import annotations

import json
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from roadveil.operators import ingest
from roadveil.sources import featurefile

ODD = ['{"type":"Feature"', "\\", '\\"', "}]", "[{", 'end"', "\\\\", "ü€😀", "\n\t", ""]


def saved(text: str) -> str:
    path = tempfile.mktemp(prefix="spark-", dir="/tmp")
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def document(n: int, seed: int = 1, **style) -> tuple[str, list]:
    rng = random.Random(seed)
    point = lambda: [rng.randrange(-180, 180), rng.random()]
    made = [{"type": "Feature", "properties": {"id": k, "odd": "".join(rng.choices(ODD, k=rng.randrange(6))), "in": [{"a": [{}]}]}, "geometry": {"type": "Point", "coordinates": point()}} for k in range(n)]
    return json.dumps({"crs": {"type": "name", "properties": {"name": 'x{"'}}, "list": [{"type": "other"}], "features": made, "after": [[{}], {"b": 1}]}, **style), made


def read(spark, path, span):
    return [json.loads(r.feature) for r in featurefile.read_features(spark, path, span).collect()]


@pytest.mark.parametrize("style", [{}, {"indent": 1, "ensure_ascii": False}, {"separators": (",", ":"), "ensure_ascii": False}])
def test_parts_give_what_json_reads(spark, style):
    text, made = document(60, **style)
    path = saved(text)
    for span in (333, 4_001, 1 << 20):
        assert sorted(read(spark, path, span), key=lambda f: f["properties"]["id"]) == made


def test_every_cut_of_a_short_document(monkeypatch):
    text, made = document(4, 7, separators=(",", ":"), ensure_ascii=False)
    data, path = text.encode(), saved(text)
    size = len(data)
    monkeypatch.setattr(featurefile, "BLOCK", 5)
    import pyarrow as pa

    for span in range(1, size + 1, 7):
        n = -(-size // span)
        sums = [r for b in featurefile.summed(path, size, span)([pa.RecordBatch.from_pydict({"part": list(range(n))})]) for r in b.to_pylist()]
        odd = depth = 0
        states = []
        for s in sums:
            states.append((s["part"], odd, depth))
            depth += s["inside" if odd else "outside"]
            odd ^= s["odd"]
        assert (odd, depth) == (0, 0)
        part = pa.RecordBatch.from_pydict(dict(zip(("part", "odd", "depth"), map(list, zip(*states, strict=True)), strict=True)))
        found = [json.loads(f) for b in featurefile.cut(path, size, span)([part]) for f in b.column("feature").to_pylist()]
        assert [f for f in found if f.get("type") == "Feature"] == made


def test_written_is_read_and_is_json(spark):
    rows = [(k, json.dumps({"type": "Feature", "properties": {"t": ODD[k % len(ODD)] * k}}, ensure_ascii=False) if k % 9 else None) for k in range(400)]
    path = tempfile.mktemp(prefix="spark-", dir="/tmp")
    size = featurefile.write_features(spark, spark.createDataFrame(rows, "k long, feature string").repartition(7), ["k"], path)
    with open(path, "rb") as f:
        data = f.read()
    wanted = [json.loads(t) for _, t in rows if t]
    assert len(data) == size and json.loads(data)["features"] == wanted
    key = lambda f: f["properties"]["t"]
    assert sorted(read(spark, path, 1_000), key=key) == sorted(wanted, key=key)


def test_no_features_and_documents_that_end_early(spark):
    path = tempfile.mktemp(prefix="spark-", dir="/tmp")
    featurefile.write_features(spark, spark.createDataFrame([], "k long, feature string"), ["k"], path)
    with open(path) as f:
        assert json.load(f)["features"] == []
    assert read(spark, path, 10) == [] and read(spark, saved(""), 10) == []
    text, _ = document(20)
    for broken in (text[:-1], text[: len(text) // 2], text + "}"):
        with pytest.raises(Exception, match="last bracket|has not begun"):
            read(spark, saved(broken), 500)


def test_outer_rings_become_walls(spark):
    square, hole = [[0, 0], [9, 0], [9, 9], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]
    shapes = [("Polygon", [square, hole]), ("Polygon", []), ("Point", [1, 2]), ("MultiPolygon", [[square]]), ("Polygon", None)]
    rows = [(json.dumps({"type": "Feature", "properties": {"bid": str(k)}, "geometry": {"type": t, "coordinates": c}}),) for k, (t, c) in enumerate(shapes)]
    found = featurefile.ring_points(spark.createDataFrame(rows, "feature string"), F.col("f.properties")["bid"].cast("long"))
    walls = sorted((r.bid, r.wall, r.px, r.py, r.qx, r.qy) for r in ingest.walls(found).collect())
    assert walls == [(0, k + 1, *map(float, square[k]), *map(float, square[k + 1])) for k in range(3)]
