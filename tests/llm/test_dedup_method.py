"""The pipeline's near-duplicates are those of operator 1: fingerprints at three bits, linked one to the next."""

import random

import corpus_pipeline
from roadveil.llm import simhash

SF = "/root/testdata/sf0.001"


def test_dedup_stage_keeps_the_first_of_linked_fingerprints(spark):
    rng = random.Random(3)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    for k in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for i in range(4):  # each a little further from the first
            rows.append((10_000 + 4 * k + i, " ".join(words)))
            words[rng.randrange(200)] = "changed"
    rows += [(20_000, None), (20_001, ""), (20_002, " \n"), (20_003, "one two"), (20_003, "one two"), (20_003, "another text"), (None, "one two"), (None, None)]
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    first = {}
    for (i, _), r in zip(rows, root, strict=True):
        if i is not None:
            first[r] = min(i, first.get(r, i))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = corpus_pipeline.dedup_stage(spark, docs, SF)
    assert got.columns == docs.columns
    assert sorted(r[0] for r in got.collect() if r[0] is not None) == sorted(first.values())
    assert sum(r[0] is None for r in got.collect()) == 2
    assert 30 < sum(10_000 <= i < 20_000 for i in first.values()) < 120
    assert corpus_pipeline.dedup_stage(spark, docs.limit(0), SF).count() == 0
