"""Groups at a 5-word Jaccard of 0.8, long texts among them, against brute force."""

from __future__ import annotations

import numpy as np

from roadveil.llm import shingles, simhash


def changed(rng, words, share):
    return [w if rng.random() >= share else f"new{rng.integers(1 << 40)}" for w in words]


def test_parities_never_say_more_than_the_sets_differ_by():
    rng = np.random.default_rng(3)
    for n in (1, 2047, 2049, 9000):
        a = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        for share in (0.02, 0.1, 1.0):
            b = np.unique(np.where(rng.random(len(a)) < share, rng.integers(-(1 << 62), 1 << 62, len(a)), a))[: max(1, round(len(a) * 0.95))]
            apart = shingles.odd_apart(shingles.parities(a), shingles.parities(b))
            assert apart <= len(np.setxor1d(a, b))
            assert share < 1 or n < 9 or 9 * apart > len(a) + len(b)  # unlike sets are told apart whatever their size


def test_keep_one_of_long_texts_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = []
    for size in (40, 3000, 6000):
        base = [f"w{rng.integers(1 << 30)}" for _ in range(size)]
        texts += [" ".join(changed(rng, base, share)) for share in (0, 0, 0.002, 0.01, 0.02, 0.03, 0.06, 0.3)]
    texts += [None, "", "a b", "A  b"]
    held = [set(shingles.shingle_set((t or "").encode()).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(held[i] & held[j]) >= 4 * len(held[i] | held[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(spark, docs).collect()) == sorted(set(root))


def test_places_never_rule_out_similar_sets(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(400):
        pool = rng.permutation(60)
        a, b = set(pool[: rng.integers(1, 50)].tolist()), set(pool[rng.integers(0, 6) : rng.integers(7, 56)].tolist())
        x, y = sorted(a), sorted(b)
        if a & b:
            low = min(a & b)
            rows.append((len(x), x.index(low), len(y), y.index(low), 5 * len(a & b) >= 4 * len(a | b)))
    assert any(r[4] for r in rows)
    df = spark.createDataFrame(rows, "n long, at long, m long, by long, similar boolean")
    assert df.filter("similar").filter(~shingles.may_share(*(df[c] for c in ("n", "at", "m", "by")))).count() == 0
    assert df.filter(shingles.may_share(*(df[c] for c in ("n", "at", "m", "by")))).count() < len(rows)


def test_components_under_a_hot_passage_match_brute_force(spark):
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(1 << 30)}"
    passage, other = [word() for _ in range(90)], [word() for _ in range(60)]
    texts = []
    for k in range(240):
        own = [word() for _ in range(int(rng.integers(2, 60)))]
        cut = passage[: int(rng.integers(60, 91))]
        texts += [" ".join(cut + own)] if k % 3 else [" ".join(cut + own), " ".join(cut + own + [word()] * (k % 5)), " ".join(other + cut[:40] + own[:4])]
    texts += [" ".join(changed(rng, passage, 0.004)) for _ in range(40)]
    held = {shingles.text_key(t.encode()): set(shingles.shingle_set(t.encode()).tolist()) for t in texts}
    names = [int(np.array(k, np.uint64).view(np.int64)) for k in held]
    root = dict(zip(names, names, strict=True))
    for i, (a, x) in enumerate(zip(names, held.values(), strict=True)):
        for b, y in list(zip(names, held.values(), strict=True))[:i]:
            if 5 * len(x & y) >= 4 * len(x | y) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if r == high else r for k, r in root.items()}
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.node: r.root for r in shingles.components(spark, docs).collect()}
    assert {k: got.get(k, k) for k in names} == root


def test_tallies_add_up_over_tasks_and_never_fall_short(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{rng.integers(40)}" for _ in range(30)) for _ in range(60)] + [None, "", "a b"]
    held = np.concatenate([shingles.shingle_set((t or "").encode()) for t in {t or "" for t in texts}])
    got = shingles.tallies(spark, spark.createDataFrame([(t,) for t in texts], "text string").repartition(5))
    cells, times = np.unique(held & (shingles.CELLS - 1), return_counts=True)
    assert (got[cells] >= times).all() and got.sum() >= len(held) and (got > 0).sum() == len(cells)
    level = shingles.ranks(got)
    assert (level[got <= 1] == 0).all() and (level[got > 1] >= 1).all()
