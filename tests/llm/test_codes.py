"""Vector codes against full scans and SQL."""

import hashlib

import duckdb
import numpy as np
import pytest

from roadveil.llm import codes, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "label int, embedding array<float>, vec_id long, part string, code int, entry string"


def plain(rows, entries, rounds=4, parts=4):
    """``(vec_id, embedding, label)`` rows, every part compared with every entry in every round, in whole numbers."""
    kept = [(i, np.array([int(np.floor(np.float64(np.float32(x)) * 1024)) for x in v]), label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    z = np.array([v for _, v, _ in kept]).reshape(len(kept), parts, -1)
    books = z[:entries].transpose(1, 0, 2).copy()
    for turn in range(rounds + 1):
        away = ((z[:, :, None] - books[None]) ** 2).sum(3)
        code = away.argmin(2)
        for p in range(parts if turn < rounds else 0):
            for e in range(books.shape[1]):
                own = z[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    error = away.min(2).sum(1)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    total = {}
    for (_, _, label), e in zip(kept, error.tolist(), strict=True):
        total[label] = total.get(label, 0) + e
    return sorted(((i, bytes(c.astype(np.uint8)).hex(), e, total[label], digest) for (i, _, label), c, e in zip(kept, code, error.tolist(), strict=True)), key=repr)


def got(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 0.3, (9, 8))
    rows = [(i, (centres[i % 9] + rng.normal(0, 0.05, 8)).astype(np.float32).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(400).tolist()]
    rows += [(500 + i, rows[0][1], 7) for i in range(200)]  # a third of all are one vector
    rows += [(3, rows[5][1], 1), (None, rows[6][1], 1), (900, None, 1), (901, [0.5] * 7 + [None], 2), (902, [0.5] * 7 + [float("nan")], 2), (903, [float("inf")] * 8, None), (904, [0.5] * 7 + [0.25], None)]
    table = spark.createDataFrame([(label, v, i, "clash", 1, "clash") for i, v, label in rows], SCHEMA)
    for entries in (16, 256):
        assert got(codes.compress(spark, table, entries)) == plain(rows, entries)
    # of vectors with other lengths none takes part
    odd = table.unionByName(spark.createDataFrame([(1, [], 950, "", 1, ""), (1, [0.1] * 4, 951, "", 1, "")], SCHEMA))
    assert got(codes.compress(spark, odd, 16)) == plain(rows, 16)


def test_fewer_rows_than_entries_and_none(spark):
    rows = [(5, [0.1, -0.1, 0.2, -0.2], None), (2, [0.1, -0.1, 0.2, 0.3], None)]
    assert got(codes.compress(spark, spark.createDataFrame([(l, v, i, "", 0, "") for i, v, l in rows], SCHEMA))) == plain(rows, 256)
    assert got(codes.compress(spark, spark.createDataFrame([], SCHEMA))) == []
    assert got(codes.compress(spark, spark.createDataFrame([(1, None, 4, "", 0, "")], SCHEMA))) == []
    with pytest.raises(Exception, match="too large"):
        codes.compress(spark, spark.createDataFrame([(1, [4096.0] * 4, 4, "", 0, "")], SCHEMA)).collect()


def test_active_entries_spare_work_and_keep_ties():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (3000, 2)).astype(np.float64)  # few values, so many ties
    first = rng.integers(-3, 4, (64, 2))
    one = codes.Lloyd(first, np.ones(64, bool))
    code, away = one.assign(x, None, None)
    assert one.computed == 3000 * 64
    for _ in range(20):
        after = first.copy()
        after[rng.integers(0, 64, 3)] += rng.integers(-1, 2, (3, 2))
        moved = (after != first).any(1)
        step = codes.Lloyd(after, moved)
        code, away = step.assign(x, code.astype(np.uint8), away.astype(np.int64))
        whole = ((x[:, None] - after[None]) ** 2).sum(2)
        assert (code == whole.argmin(1)).all() and (away == whole.min(1)).all()
        assert step.computed < 0.5 * whole.size
        first = after


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    wanted = con.sql(f"SELECT vec_id, code, error, label_error, codebooks_sha256 FROM ({codes.oracle_sql()})").fetchall()
    assert got(queries.op11_vector_codes(spark, SF)) == sorted(wanted, key=repr)
    assert len(wanted) == 500
