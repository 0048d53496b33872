"""Street network, sensors, walls and requests, derived from the supplied tables.

Each table is one SQL text over the supplied tables with whole-number arithmetic, so that
any engine gives the same rows; ``{name}`` stands for a table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SUPPLIED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL = {
    "nodes": """SELECT c_custkey AS node_id,
        CAST(400000 + (c_custkey % 25) * 80 + (c_custkey * 7919) % 31 AS DOUBLE) AS x,
        CAST(5800000 + CAST((c_custkey - c_custkey % 25) / 25 AS BIGINT) * 80 + (c_custkey * 104729) % 29 AS DOUBLE) AS y
      FROM {customer}""",
    "extent": "SELECT CAST(count(*) / 25 AS BIGINT) * 80 AS height FROM {customer}",
    "steps": """SELECT o_orderkey AS k, o_custkey AS u,
        CASE o_orderkey % 4 WHEN 0 THEN o_custkey + 1 WHEN 1 THEN o_custkey - 1 WHEN 2 THEN o_custkey + 25 ELSE o_custkey - 25 END AS v
      FROM {orders}
      WHERE NOT (o_orderkey % 4 = 0 AND o_custkey % 25 = 24) AND NOT (o_orderkey % 4 = 1 AND o_custkey % 25 = 0)""",
    "edges": """SELECT s.k, s.u, s.v, a.x AS ax, a.y AS ay,
        (a.x + b.x) / 2 + 3 * ((s.k % 5) - 2) AS mx, (a.y + b.y) / 2 + 3 * ((s.k % 5) - 2) AS my, b.x AS bx, b.y AS by_
      FROM {steps} s JOIN {nodes} a ON s.u = a.node_id JOIN {nodes} b ON s.v = b.node_id""",
    "segments": """SELECT k, u, v, seg, CASE seg WHEN 1 THEN ax ELSE mx END AS x0, CASE seg WHEN 1 THEN ay ELSE my END AS y0, CASE seg WHEN 1 THEN mx ELSE bx END AS x1, CASE seg WHEN 1 THEN my ELSE by_ END AS y1
      FROM {edges} CROSS JOIN (SELECT * FROM (VALUES (1), (2)) AS t(seg)) p""",
    "lengths": """SELECT k, u, v, CAST(floor(100 * (sqrt((mx - ax) * (mx - ax) + (my - ay) * (my - ay)) + sqrt((bx - mx) * (bx - mx) + (by_ - my) * (by_ - my))) + 0.5) AS BIGINT) AS length_cm
      FROM {edges}""",
    "sensors": """SELECT p_partkey AS cam_id, CAST(400000 + (p_partkey * 7919) % 2000 AS DOUBLE) AS x,
        CAST(5800000 + (p_partkey * 104729) % height AS DOUBLE) AS y,
        CASE WHEN p_partkey % 3 = 0 THEN CAST((p_partkey * 37) % 360 AS DOUBLE) END AS bearing
      FROM {part} CROSS JOIN {extent} WHERE p_size % 5 = 0""",
    "features": """SELECT CASE WHEN p_partkey % 2 = 0 THEN 'node' ELSE 'way' END AS type, p_partkey AS id,
        CASE WHEN p_partkey % 11 <> 0 THEN CAST(400000 + (p_partkey * 7919) % 2000 AS DOUBLE) END AS x,
        CASE WHEN p_partkey % 11 <> 0 THEN CAST(5800000 + (p_partkey * 104729) % height AS DOUBLE) END AS y,
        CASE p_partkey % 5 WHEN 0 THEN 'indoor' WHEN 1 THEN 'public' WHEN 2 THEN 'outdoor' END AS surveillance,
        CASE p_partkey % 8 WHEN 0 THEN 'camera;ALPR' WHEN 1 THEN ' camera ' WHEN 2 THEN 'Camera' WHEN 3 THEN '' WHEN 4 THEN 'guard' WHEN 5 THEN 'webcam' WHEN 6 THEN 'guard; ALPR' END AS kind,
        CASE p_partkey % 9 WHEN 0 THEN 'N' WHEN 1 THEN 'nnw' WHEN 2 THEN '450' WHEN 3 THEN '-10' WHEN 4 THEN '0;90' WHEN 5 THEN 'N; 180' WHEN 6 THEN '45-90' WHEN 7 THEN '45-90;N' END AS direction
      FROM {part} CROSS JOIN {extent}""",
    "mounted": """SELECT *, CASE id % 7 WHEN 0 THEN 'dome' WHEN 1 THEN 'panning' WHEN 2 THEN 'fixed' END AS mount FROM {features}""",
    "feature_nodes": "SELECT id, x, y, surveillance, kind, direction, mount FROM {mounted} WHERE type = 'node'",
    "feature_ways": "SELECT id, x AS cx, y AS cy, surveillance, kind, direction, mount FROM {mounted} WHERE type = 'way'",
    "outlines": """SELECT bid, CASE WHEN bid % 7 = 3 THEN 'relation' ELSE 'way' END AS type, n,
        CASE WHEN n IN (2, 3) THEN x0 + side ELSE x0 END AS x, CASE WHEN n IN (3, 4) THEN y0 + side ELSE y0 END AS y
      FROM {buildings} CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3), (4), (5)) AS t(n)) p
      WHERE n <= CASE bid % 5 WHEN 4 THEN 3 WHEN 0 THEN 5 ELSE 4 END""",
    "places": "SELECT c_custkey AS place_id, n_name AS name, x, y FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {nodes} ON c_custkey = node_id",
    "searches": """SELECT s_suppkey AS search_id, CASE s_suppkey % 4 WHEN 0 THEN concat('  ', substr(n_name, 1, 2), '  ') WHEN 1 THEN concat(' ', lower(n_name)) WHEN 2 THEN substr(n_name, 1, 3) WHEN 3 THEN concat(n_name, '?') END AS q
      FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "buildings": """SELECT s_suppkey AS bid, CAST(400000 + (s_suppkey * 6151) % 2000 AS DOUBLE) AS x0,
        CAST(5800000 + (s_suppkey * 3571) % height AS DOUBLE) AS y0, CAST(10 + s_suppkey % 20 AS DOUBLE) AS side
      FROM {supplier} CROSS JOIN {extent}""",
    "walls": """SELECT bid, wall, CASE WHEN wall IN (2, 3) THEN x0 + side ELSE x0 END AS px, CASE WHEN wall IN (3, 4) THEN y0 + side ELSE y0 END AS py,
        CASE WHEN wall IN (1, 2) THEN x0 + side ELSE x0 END AS qx, CASE WHEN wall IN (2, 3) THEN y0 + side ELSE y0 END AS qy
      FROM {buildings} CROSS JOIN (SELECT * FROM (VALUES (1), (2), (3), (4)) AS t(wall)) p""",
    "points": """SELECT event_id AS req_id, CAST(399700 + (event_id * 7919) % 2600 + (event_id % 7) AS DOUBLE) AS x,
        CAST(5799700 + (event_id * 104729) % (height + 600) AS DOUBLE) AS y
      FROM {events} CROSS JOIN {extent}""",
    "requests": """SELECT event_id AS req_id, a.x + 3 AS x0, a.y - 2 AS y0, b.x - 4 + 600 * CAST(event_id % 97 = 5 AS INTEGER) * CAST(event_id % 2 AS INTEGER) AS x1, b.y + 3 AS y1,
        CASE WHEN event_type IN ('click', 'view') THEN 'bike' ELSE 'walk' END AS profile,
        CAST(CASE user_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 5 WHEN 2 THEN 15 WHEN 3 THEN 60 ELSE 1000 END AS BIGINT) AS alpha
      FROM {events} CROSS JOIN (SELECT count(*) AS n FROM {nodes}) c JOIN {nodes} a ON a.node_id = user_id % n JOIN {nodes} b ON b.node_id = (event_id * 31) % n""",
    "asks": """SELECT event_id AS req_id, CASE WHEN event_id % 17 <> 0 THEN CAST((event_id * 37) % 200 - 100 AS DOUBLE) END AS lat,
        CAST((event_id * 53) % 400 - 200 AS DOUBLE) AS lon, CASE event_id % 5 WHEN 0 THEN 'walk' WHEN 1 THEN 'bike' WHEN 2 THEN 'boat' END AS profile,
        CASE WHEN event_id % 7 = 1 THEN 0.0 WHEN event_id % 7 > 1 THEN CAST((event_id * 11) % 1100 - 20 AS DOUBLE) END AS alpha
      FROM {events}""",
    "ways": """SELECT k, u, v, CASE k % 11 WHEN 0 THEN 'footway' WHEN 1 THEN 'steps' WHEN 2 THEN 'motorway' WHEN 3 THEN 'construction' WHEN 4 THEN 'cycleway' WHEN 5 THEN NULL ELSE 'residential' END AS highway,
        CASE WHEN k % 13 = 0 THEN 'yes' WHEN k % 13 = 1 THEN 'no' END AS area, CASE k % 17 WHEN 0 THEN 'private' WHEN 1 THEN 'alley' END AS service,
        CASE k % 19 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS foot, CASE k % 7 WHEN 0 THEN 'no' WHEN 1 THEN 'yes' END AS bicycle, CASE k % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS oneway
      FROM {edges}""",
    "chunks": """SELECT user_id AS load_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - CAST(1 AS BIGINT) AS chunk, 1000 + event_id % 7 * 100 AS size,
        CAST(sum(1000 + event_id % 7 * 100) OVER (PARTITION BY user_id) AS BIGINT) AS total FROM {events}""",
    "costs": """SELECT l.k, l.u, l.v, l.length_cm, (l.length_cm * (l.k % 7)) % 400 AS exposure_dm FROM {lengths} l""",
    "alphas": "SELECT * FROM (VALUES (0), (5), (15), (60), (1000)) AS t(alpha)",
}


def oracle(name_or_sql: str) -> str:
    """The text with every derived table written out, for an engine that has the supplied ones."""
    text = SQL.get(name_or_sql, name_or_sql)
    return re.sub(r"\{(\w+)\}", lambda m: m[1] if m[1] in SUPPLIED else f"({oracle(m[1])})", text)


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in SUPPLIED:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return run(spark, sf_dir, SQL[name])


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    parts = {m: derived(spark, sf_dir, m) for m in set(re.findall(r"\{(\w+)\}", text))}
    return spark.sql(text, **parts)
