"""Operator 11: vectors as four one-byte codes, by Lloyd's rounds over active entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadveil.llm.common import staged
from roadveil.llm.vectors import usable

PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: sums of squares stay exact below 2^53 in doubles, and an error below 2^63, up to this component
LARGEST = 1 << 21
#: rows that are compared at once
SLICE = 4096
#: a vector with its codes and their distances; or, ``entry`` not null, what a task's vectors add up to in an entry of a part
STATE = "vec_id long, label string, z array<int>, code binary, away array<long>, part int, entry int, n long, total array<long>"


def whole(rows: DataFrame, width: int | None) -> DataFrame:
    """``(vec_id, label, z)``: vectors whose components are all there and finite, as floor(1024 x), in the common length."""
    z = F.transform("vector", lambda x: F.floor(x.cast("double") * 1024))
    kept = rows.select(rows["vec_id"].cast("long").alias("vec_id"), rows["label"].cast("string").alias("label"), rows["embedding"].alias("vector")).filter(usable(F.col("vector")))
    checked = F.assert_true(~F.exists("vector", lambda x: F.abs(x.cast("double") * 1024) >= LARGEST), F.lit("a component is too large for exact sums"))
    return kept.filter(F.size("vector") == (0 if width is None else width)).filter(checked.isNull()).select("vec_id", "label", z.cast("array<int>").alias("z"))


class Lloyd:
    """One part position's codebook, and which of its entries the last round moved."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray):
        self.entries, self.moved = entries.astype(np.float64), np.flatnonzero(moved)
        self.is_moved = moved
        self.squares = (self.entries * self.entries).sum(1)
        self.computed = 0

    def away(self, x: np.ndarray, which: np.ndarray | slice) -> np.ndarray:
        """Squared distances, whole numbers below 2^53 and so exact: rows x the entries asked for."""
        entries = self.entries[which]
        self.computed += len(x) * len(entries)
        return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + self.squares[which]

    def rescan(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = self.away(x, slice(None))
        best = found.argmin(1)  # the first of equals
        return best, found[np.arange(len(x)), best]

    def assign(self, x: np.ndarray, code: np.ndarray | None, stored: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """A part whose entry stayed compares the moved entries alone with its stored distance, as no other entry is nearer
        than before; a part whose entry moved is compared with all."""
        if code is None:
            return self.rescan(x)
        code, stored = code.astype(np.int64), stored.astype(np.float64)
        lost = self.is_moved[code]
        if lost.any():
            code[lost], stored[lost] = self.rescan(x[lost])
        stay = np.flatnonzero(~lost)
        if len(stay) and len(self.moved):
            found = self.away(x[stay], self.moved)
            at = found.argmin(1)
            near, entry = found[np.arange(len(stay)), at], self.moved[at]
            better = (near < stored[stay]) | ((near == stored[stay]) & (entry < code[stay]))
            code[stay[better]], stored[stay[better]] = entry[better], near[better]
        return code, stored


def assigned(books: np.ndarray, moved: np.ndarray, totals: bool):
    """Partition worker: codes and distances of its vectors by the codebooks; last, what they add up to by part and entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lloyds = [Lloyd(books[p], moved[p]) for p in range(parts)]
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                n = part.num_rows
                z = part.column(2).flatten().to_numpy().reshape(n, parts, width).astype(np.float64)
                old = None
                if len(part.column(3)) - part.column(3).null_count:
                    old = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(n, parts), part.column(4).flatten().to_numpy().reshape(n, parts)
                code, away = np.empty((n, parts), np.uint8), np.empty((n, parts), np.int64)
                for p, lloyd in enumerate(lloyds):
                    code[:, p], away[:, p] = lloyd.assign(z[:, p], *((old[0][:, p], old[1][:, p]) if old else (None, None)))
                    if totals:
                        count[p] += np.bincount(code[:, p], minlength=entries)
                        for i in range(width):
                            total[p, :, i] += np.bincount(code[:, p], weights=z[:, p, i], minlength=entries).astype(np.int64)
                blank = [pa.nulls(n, k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), n, [None, pa.py_buffer(code.tobytes())]).cast(pa.binary()), lists(away), *blank], names=NAMES)
        used = np.argwhere(count)
        if len(used):
            blank = [pa.nulls(len(used), k) for k in (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*blank, pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(count[used[:, 0], used[:, 1]]), lists(total[used[:, 0], used[:, 1]])], names=NAMES)

    return run


NAMES = [f.split()[0] for f in STATE.split(", ")]


def lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32), pa.array(matrix.ravel()))


def compress(spark: SparkSession, rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, width: int | None = None) -> DataFrame:
    """``rows(vec_id, embedding, label)`` -> ``(vec_id, code, error, label_error, codebooks_sha256)``.

    A round is one pass over the vectors without a shuffle: each task assigns its own and adds up, by part and entry, what they
    come to; at most 4 x ``entries`` sums a task are shuffled, and the codebooks (4 x ``entries`` entries, all a driver ever
    holds) go out with the next pass. Vectors are kept as whole numbers beside their codes and exact distances in the shared folder,
    so that a lost executor costs its tasks alone.

    Vectors that are null, empty or hold null or non-finite components are dropped, as are those that have not the common length:
    ``width``, or that of the smallest vec_id; a length that four does not divide loses its last components (under four).
    Codebooks start with the rows of the smallest vec_ids (of one id's repeated rows in the order of their components; null ids behind
    all others), fewer where there are fewer. Null labels are one label; an empty table gives no rows; further
    columns are ignored. A component of 2^11 or more fails with a message, as sums would not be exact.
    """
    if width is None:
        first = rows.select(rows["vec_id"].alias("i"), F.size(rows["embedding"]).alias("n")).filter(usable(rows["embedding"])).agg(F.min(F.struct(F.col("i").isNull(), "i", "n"))["n"]).first()
        width = first[0]
    wide = (width or 0) // PARTS
    vectors = whole(rows, width).withColumn("z", F.slice("z", 1, PARTS * wide))
    start = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "z").limit(entries).select("z").collect() if wide else []
    books = np.array([r[0] for r in start], np.int64).reshape(len(start), PARTS, wide).transpose(1, 0, 2)
    moved = np.ones(books.shape[:2], bool)
    blank = {c: F.lit(None).cast(t) for c, t in (f.split(" ") for f in STATE.split(", ")[3:])}
    state = vectors.withColumns(blank)
    for turn in range(rounds + 1 if len(start) else 0):
        state = staged(spark, state.filter("entry IS NULL").mapInArrow(assigned(books, moved, turn < rounds), STATE), "codes")
        if turn < rounds:
            sums = state.filter("entry IS NOT NULL").groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(wide)])
            fresh = books.copy()
            for r in sums.collect():  # at most 4 x entries
                fresh[r["part"], r["entry"]] = np.array(r[3:], np.int64) // r["n"]
            moved, books = (fresh != books).any(2), fresh
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    found = state.filter("entry IS NULL").select("vec_id", "label", F.lower(F.hex("code")).alias("code"), F.aggregate("away", F.lit(0).cast("long"), lambda s, x: s + x).alias("error"))
    return with_label_error(found).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def with_label_error(found: DataFrame, most: int = 100_000) -> DataFrame:
    """The sum over equal labels beside every row: few labels go to the rows, many are joined (a hot one is split by adaptive execution)."""
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "l")
    few: Column = F.col("label").eqNullSafe(F.col("l"))
    return found.join(F.broadcast(sums) if sums.limit(most + 1).count() <= most else sums, few)


def oracle_sql(rounds: int = ROUNDS, entries: int = ENTRIES) -> str:
    """Every round compares every part with every entry."""
    near = lambda book: f"""SELECT vec_id, label, part, arg_min(entry, (away, entry)) AS entry, min(away) AS away, any_value(x) AS x FROM (
        SELECT vec_id, label, p.part, p.x, b.entry, list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, b.x) + list_dot_product(b.x, b.x) AS away FROM pieces p JOIN {book} b ON b.part = p.part) d
        GROUP BY vec_id, label, part"""  # noqa: E731
    steps = "".join(f""",
      a{r} AS MATERIALIZED ({near(f'b{r}')}),
      b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(n.x, o.x) AS x FROM b{r} o LEFT JOIN (
        SELECT part, entry, list(floor(s / n) ORDER BY i) AS x FROM (SELECT part, entry, i, sum(v) AS s, count(*) AS n FROM (
          SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{r}) u GROUP BY part, entry, i) m GROUP BY part, entry) n USING (part, entry))""" for r in range(rounds))
    return f"""
      WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS z FROM embeddings
          WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pieces AS MATERIALIZED (SELECT vec_id, label, part, z[part * (len(z) // 4) + 1 : (part + 1) * (len(z) // 4)] AS x FROM (SELECT *, unnest(range(4)) AS part FROM kept) k),
        b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM pieces QUALIFY entry < {entries}){steps},
        last AS MATERIALIZED ({near(f'b{rounds}')}),
        digest AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(x) AS v, unnest(range(len(x))) AS i FROM b{rounds}) u),
        codes AS (SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(away) AS BIGINT) AS error FROM last GROUP BY vec_id, label)
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM codes, digest"""
