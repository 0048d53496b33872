"""The trie of conversations against brute force and SQL."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from roadveil.llm import queries, turntrie

SCHEMA = "text string, turn long, conv_id long, role string, path string, key int"


def plain(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    nodes = {}
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    out = []
    for p, convs in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        words = lambda q: len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) if q else 0
        childless = lambda q: not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in nodes)
        ends = ",".join(str(c) for c in convs if len(paths[c]) == len(p))
        out.append((convs[0], len(p), nodes[p[:-1]][0] if p else None, len(convs), sum(len(q) == len(p) + 1 for q in under), sum(map(childless, under)), sum((len(nodes[q]) - 1) * words(q) for q in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=lambda r: (r[0], r[1]))


def made(seed, convs=160):
    rng, rows = random.Random(seed), []
    first = rng.choice("ab") * 3
    for c in rng.sample(range(convs * 2), convs):
        copy = rng.random() < 0.35  # a third of all are copies of one conversation
        for t in range(4 if copy else rng.choice([1, 1, 2, 3, 5, 9])):
            text = "same turn" if copy else rng.choice([first, "x y", "", None, "z\tz\x0b z", " é", "w " * 50])
            rows.append((c, None if t == 0 and rng.random() < 0.3 else t, rng.choice(["user", None]) if not copy else "user", text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_brute_force_whatever_the_blocks(spark, seed):
    rows = [*made(seed), (None, 1, "user", "lost"), (7777, 3, "a", "b"), (7777, 3, "a", "b"), (-25, 1, "a", "b")]
    # one turn number twice in a conversation only where the turns are alike, as their order is by ids else
    table = spark.createDataFrame([(text, turn, conv, role, "clash", 1) for conv, turn, role, text in rows], SCHEMA)
    want = plain(rows)
    assert rows_of(turntrie.prefix_trie(spark, table)) == want
    for cells, parts in ((1, 1), (40, 3), (1 << 20, 37)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert rows_of(turntrie.trie(spark, turntrie.rebuilt(table), cells)) == want
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert turntrie.prefix_trie(spark, empty).collect() == []
    # a conversation whose only turn is given up for a head that isn't there ends at the root
    lone = next(c for c in range(21, 99) if zlib.crc32(str(c).encode()) % 4 > 0)
    got = rows_of(turntrie.prefix_trie(spark, spark.createDataFrame([("t", 0, lone, "user", "", 0)], SCHEMA)))
    assert got == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
    # a very long conversation
    rows = [(20, t, "user", "a b") for t in range(3000)] + [(40, t, "user", "a b") for t in range(2999)]
    got = turntrie.prefix_trie(spark, spark.createDataFrame([(text, t, c, role, "", 0) for c, t, role, text in rows], SCHEMA))
    assert got.count() == 3001
    assert tuple(got.filter("depth = 0").first()) == (20, 0, None, 2, 1, 1, 2 * 2999, turntrie.NONE)
    assert got.filter(F.col("ends_sha256") != turntrie.NONE).count() == 2


def test_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM read_parquet('/root/testdata/sf0.001/conversations.parquet')")
    wanted = con.sql(f"SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM ({turntrie.oracle_sql()})").fetchall()
    found = queries.op13_conversation_trie(spark, "/root/testdata/sf0.001")
    assert rows_of(found) == sorted(wanted, key=lambda r: (r[0], r[1]))
    assert len(wanted) == found.count()
