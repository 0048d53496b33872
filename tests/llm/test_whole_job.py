"""Whole results where a bound or a floor cut them before."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadveil.llm import pii, queries, simhash, topk, urlfilter


def test_terms_of_once_mentioned_entities_anywhere_in_the_text(spark):
    rng = random.Random(7)
    noise = lambda n: " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) for _ in range(n))
    rows = [(0, f"zorro {noise(300)} z@secret.org {noise(300)} Quixote"), *((i, noise(20)) for i in range(1, 200)), (200, rows_again := f"{noise(9)} twice@else.org {noise(9)} halfrare"), (201, rows_again), (202, f"{noise(9)} halfrare")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = {i: {w.lower() for w in t.replace("@", " ").replace(".", " ").split()} for i, t in rows}
    n_of = lambda t: sum(t in w for w in words.values())
    for i, text in rows:
        base = pii.base_spans(text)
        want, entity = [], {0: "z@secret.org", 200: "twice@else.org", 201: "twice@else.org"}.get(i)
        own = [j for j, t in rows if entity and entity in t]
        for m in pii.free_words(text, base) if entity else ():
            term = m[0].lower()
            both = sum(term in words[j] for j in own)
            pmi, ic = math.log2(len(rows) * both / (len(own) * n_of(term))), math.log2(len(rows) / len(own))
            if pmi > 0 and (pmi >= ic / 1.5 or pmi >= max(1, ic / 3)):
                want.append(("term_remove" if pmi >= ic / 1.5 else "term_generalise", m.start(), m.end()))
        assert got[i] == pii.said([*base, *sorted(want)])
    assert "term_remove:0:5" in got[0] and "term_remove" in got[200] and got[200] == got[201] and got[202] == ""


def similar_groups(texts):
    """Root of every text by brute force: 5-word Jaccard of 0.8 or more, transitively."""
    sets, root = [], list(range(len(texts)))
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(n) for n in range(len(texts))]


def test_near_dedup_keeps_what_brute_force_keeps(spark):
    rng = random.Random(9)
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    for k in range(40):  # around the bound, on either side
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        rows.append((10_000 + 2 * k, " ".join(words)))
        for at in rng.sample(range(120), 1 + k % 5):
            words[at] = "changed"
        rows.append((10_001 + 2 * k, " ".join(words)))
    rows += [(20_000, "a text that stands here under one id"), (20_000, rows[-1][1] + " more"), (20_001, "one two three"), (20_002, "One  two THREE")]
    rows = sorted(rows, key=lambda r: r[0])
    want = [rows[i] for i, r in enumerate(similar_groups([t for _, t in rows])) if r == i]
    got = simhash.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told = lambda many: sorted((i, " ".join((t or "").lower().split())) for i, t in many)
    assert told(map(tuple, got)) == told(want)
    assert 0 < sum(10_000 < i < 20_000 and i % 2 for i, _ in want) < 40


def test_distrust_reaches_far_hosts(spark):
    hosts = [f"h{i}.{'org' if i < 12 else 'com'}" for i in range(30)]  # those of com have trust, so that 31 hosts have a score
    chain = [*hosts[:12], "bad.net"]  # h0 links over 12 hops to a blocked page
    rows = [(i, f"http://{a}/x", f"<a href='http://{b}/fr/'>") for i, (a, b) in enumerate(zip(chain, chain[1:], strict=False))]
    rows += [(99, "http://bad.net/fr/", ""), *((100 + i, f"http://{h}/", f"<a href='http://{hosts[12 + (i + 1) % 18]}/'>") for i, h in enumerate(hosts[12:]))]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # distrust 0.15 * 0.85**12 = 0.021 against 1 / (2 * 31) = 0.016
    assert [got[i] for i in range(12)] == ["block"] * 12 and got[100] == "allow"


@pytest.mark.parametrize("shard_rows, block, most_pivots", [(8192, 65536, 1024), (40, 16, 6), (10, 7, 64)])
def test_top_k_over_many_shards_meets_the_sql(spark, shard_rows, block, most_pivots):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(8, 12)) * 3
    rows = [(i, (centres[i % 8] + 0.05 * rng.normal(size=12)).tolist()) for i in range(400)]
    rows += [rows[20], rows[20], rows[7], (401, [0.0] * 12), (402, rows[20][1]), (403, [1.0, 2.0]), (440, [3.0, 4.0]), (460, [-9.0] * 12)]
    con = duckdb.connect()
    embeddings = pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))})
    con.register("embeddings", embeddings)
    want = sorted(con.sql(queries.oracle_sql()["op9_exact_top_k"]).select("query_id", "rank", "vec_id", "score").fetchall())
    found = topk.top_k(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, shard_rows=shard_rows, block=block, most_pivots=most_pivots)
    assert sorted(map(tuple, found.collect())) == want


def test_m_trees_spare_computations():
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(60, 16)) * 40
    rows = np.floor(centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16)))
    tree = topk.MTree(np.arange(6000), rows, float((rows * rows).sum(1).max()), page=64)
    for i in range(0, 6000, 300):
        scores = rows @ rows[i]
        scores[i] = -np.inf
        want = sorted(((-s, j) for j, s in enumerate(scores.tolist())))[:20]
        assert sorted((-s, j) for s, j in tree.search(i, rows[i], 20)) == want
    assert tree.computed < 0.5 * 20 * 6000
