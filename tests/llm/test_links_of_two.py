"""What two vectors are to each other does not depend on how many others there are."""

import numpy as np

from roadveil.llm import lattice


def test_links_do_not_depend_on_the_number_of_rows(spark, monkeypatch):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(400, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    rows = np.concatenate([base, 0.951 * base + np.sqrt(1 - 0.951**2) * side])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
    few = sorted(map(tuple, lattice.near_duplicates(spark, df).collect()))
    monkeypatch.setattr(type(df), "count", lambda self: 10**9)  # a table that says it is large
    assert sorted(map(tuple, lattice.near_duplicates(spark, df).collect())) == few
    assert sum(r[1] for r in few) >= 0.9 * 800
