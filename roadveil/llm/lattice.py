"""Operator 10: embedding near-duplicates by E8 lattice hashing."""

from __future__ import annotations

import math
from functools import cache, lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadveil.llm.common import staged
from roadveil.llm.components import connected_components, forest
from roadveil.llm.vectors import matrices, usable

PLACED = "bucket long, asks boolean, table int, size int, node string, n long, data binary"


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Integer points of even sum: round, then move the worst coordinate if the sum is odd."""
    whole = np.floor(x + 0.5)
    rest = x - whole
    worst = np.abs(rest).argmax(1)
    rows = np.arange(len(x))
    odd = whole.sum(1).astype(np.int64) % 2 != 0
    whole[rows, worst] += np.where(odd, np.where(rest[rows, worst] >= 0, 1.0, -1.0), 0.0)
    return whole


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """E8 is D8 and D8 shifted by one half: the nearer of the two decodings."""
    plain, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    return np.where((((x - plain) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], plain, half)


@cache
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to the neighbouring cells."""
    pairs = [[s if i == a else t if i == b else 0.0 for i in range(8)] for a, b in combinations(range(8), 2) for s in (1.0, -1.0) for t in (1.0, -1.0)]
    halves = [list(v) for v in product((0.5, -0.5), repeat=8) if sum(c < 0 for c in v) % 2 == 0]
    return np.array(pairs + halves)


#: per number of E8 blocks in a cell's name: tables, and cells asked besides the home cell
TABLES = {1: (2, 8), 2: (4, 24), 3: (8, 48)}
#: side of a lattice cell for vectors of 64 components; projected lengths shrink with the root of the number of components
SCALE = 0.2


@lru_cache(maxsize=64)
def projection(size: int, table: int, blocks: int, seed: int = 88) -> np.ndarray:
    """Random orthonormal directions, eight a block (fewer components: padded)."""
    basis = np.linalg.qr(np.random.default_rng([seed, table]).normal(size=(max(size, 8 * blocks), 8 * blocks)))[0]
    return basis[:size]


def cells(unit: np.ndarray, table: int, blocks: int, probes: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of every row and the neighbouring cells nearest to it over all blocks, as twice the coordinates."""
    size = unit.shape[1]
    x = (unit @ projection(size, table, blocks) / (scale * math.sqrt(64 / size))).reshape(-1, 8)
    home = nearest_e8(x)
    steps = np.concatenate([np.zeros((1, 8)), shortest()])
    # |x - home - step|^2 orders neighbours as |step|^2 - 2 (x - home) step; each block's nearest are enough
    far = (steps * steps).sum(1)[None] - 2 * (x - home) @ steps.T
    kept = min(probes, 240) + 1
    near = np.argsort(far, 1, kind="stable")[:, :kept]
    costs = np.take_along_axis(far, near, 1).reshape(-1, blocks, kept)
    ways = home[:, None] + steps[near]
    # choices of one neighbour a block, the cheapest first; the choice of all homes is left out
    total, which = costs[:, 0], np.arange(kept)[None, :, None].repeat(len(unit), 0)
    for b in range(1, blocks):
        sums = (total[:, :, None] + costs[:, b, None, :]).reshape(len(unit), -1)
        first = np.argsort(sums, 1, kind="stable")[:, :kept]
        total = np.take_along_axis(sums, first, 1)
        which = np.concatenate([np.take_along_axis(which, (first // kept)[:, :, None], 1), (first % kept)[:, :, None]], 2)
    ways, home = ways.reshape(len(unit), blocks, kept, 8), home.reshape(len(unit), 8 * blocks)
    out = np.concatenate([np.take_along_axis(ways[:, b], which[:, :, b, None], 1) for b in range(blocks)], 2)
    at_home = (out == home[:, None]).all(2)
    order = np.argsort(at_home, 1, kind="stable")[:, :probes]  # home, where it is among them, goes last
    return np.rint(2 * home).astype(np.int16), np.rint(2 * np.take_along_axis(out, order[:, :, None], 1)).astype(np.int16)


def place(rows: DataFrame, blocks: int, tables: int, probes: int, scale: float) -> DataFrame:
    """One row for each table at the home cell and one for each neighbouring cell asked."""

    def run(batches):
        for b in batches:
            nodes, weights = b.column(0), b.column(1)
            for picked, matrix in matrices(b.column(2)):
                for at in range(0, len(picked), 512):
                    part, vectors = picked[at : at + 512], matrix[at : at + 512]
                    data = pa.array([v.tobytes() for v in packed(vectors)], pa.binary())
                    unit, buckets, asks, rows_, tabled = unit_rows(vectors), [], [], [], []
                    for t in range(tables):
                        home, near = cells(unit, t, blocks, probes, scale)
                        names = np.concatenate([home[:, None], near], 1)
                        mark = f"{unit.shape[1]}:{t}:".encode()
                        buckets += [xxhash.xxh64_intdigest(mark + c.tobytes()) - (1 << 63) for c in names.reshape(-1, names.shape[2])]
                        asks.append(np.tile(np.arange(names.shape[1]) > 0, len(part)))
                        rows_.append(np.repeat(np.arange(len(part)), names.shape[1]))
                        tabled.append(np.full(names.shape[0] * names.shape[1], t, np.int32))
                    own = np.concatenate(rows_)
                    back = pa.array(part[own])
                    yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(np.concatenate(asks)), pa.array(np.concatenate(tabled)), pa.array(np.full(len(own), unit.shape[1], np.int32)), nodes.take(back), weights.take(back), data.take(pa.array(own))], names=[c.split()[0] for c in PLACED.split(", ")])

    return rows.select("node", "n", "v").mapInArrow(run, PLACED)


def packed(vectors: np.ndarray) -> list[np.ndarray]:
    """As four-byte numbers where nothing is lost, else as they are."""
    short = vectors.astype(np.float32)
    exact = (short == vectors).all(1)
    return [s if e else v for s, e, v in zip(short, exact, vectors, strict=True)]


def unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def read_rows(data: list[bytes], size: int) -> np.ndarray:
    return unit_rows(np.array([np.frombuffer(d, np.float32 if len(d) == 4 * size else np.float64) for d in data], np.float64))


class Meeting:
    """The home rows of one block of a cell, the rows that meet them, and what was found.

    Close pairs are not written out: every row's links are added up, and of the pairs only as many go on as
    hold the block's components together. A pair counts in one place alone: the first table in which its rows meet, and there
    in the cell that the smaller of the two asks, if it does, else in the other's.
    """

    def __init__(self, table: int, size: int, threshold: float, blocks: int, probes: int, scale: float):
        self.table, self.size, self.threshold, self.parameters = table, size, threshold, (blocks, probes, scale)
        self.nodes, self.weights, self.data, self.unit = [], [], [], None
        self.links: dict[str, int] = {}
        self.ends: tuple[list, list] = ([], [])

    def wait(self, nodes, weights, data) -> None:
        self.nodes += nodes
        self.weights += weights
        self.data += data
        self.unit = None

    def meet(self, nodes, asks, weights, data) -> None:
        if not self.nodes or not nodes:
            return
        if self.unit is None:
            self.unit = read_rows(self.data, self.size)
        unit = read_rows(data, self.size)
        p, q = np.nonzero(unit @ self.unit.T >= self.threshold)
        names, homes = np.array(nodes), np.array(self.nodes)
        smaller, apart = names[p] < homes[q], names[p] != homes[q]
        asks = np.array(asks)[p]
        # rows of one home cell meet either way round; one way counts
        keep = apart & (asks | smaller)
        p, q, smaller, asks = p[keep], q[keep], smaller[keep], asks[keep]
        if not len(p):
            return
        count = ~self.earlier(unit, p, q, smaller, asks)
        a, b, heavy, w = names[p], homes[q], np.array(self.weights), np.array(weights)
        for own, other in ((a[count], heavy[q[count]]), (b[count], w[p[count]])):
            for node, n in zip(*summed(own, other), strict=True):
                self.links[node] = self.links.get(node, 0) + n
        ids = {x: i for i, x in enumerate(dict.fromkeys([*nodes, *self.nodes]))}
        back = list(ids)
        x, y = forest(np.array([ids[n] for n in nodes])[p], np.array([ids[n] for n in self.nodes])[q])
        self.ends[0].extend(back[i] for i in x)
        self.ends[1].extend(back[i] for i in y)

    def earlier(self, unit, p, q, smaller, asks) -> np.ndarray:
        """Whether a pair has its place in an earlier table, or in the other's cell of this one."""
        out = np.zeros(len(p), bool)
        left, i = np.unique(p, return_inverse=True)
        right, j = np.unique(q, return_inverse=True)
        for t in range(self.table + 1):
            ha, na = cells(unit[left], t, *self.parameters)
            hb, nb = cells(self.unit[right], t, *self.parameters)
            for at in range(0, len(p), 1 << 15):
                s, i_, j_ = slice(at, at + (1 << 15)), i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                b_asks = (nb[j_] == ha[i_][:, None]).all(2).any(1)
                if t < self.table:
                    out[s] |= (ha[i_] == hb[j_]).all(1) | (na[i_] == hb[j_][:, None]).all(2).any(1) | b_asks
                else:
                    out[s] |= asks[s] & ~smaller[s] & b_asks
        return out

    def rows(self):
        nodes = list(self.links)
        a, b = self.ends
        none = [None] * len(nodes)
        yield pa.RecordBatch.from_arrays([pa.array([*nodes, *a], pa.string()), pa.array([*none, *b], pa.string()), pa.array([*(int(self.links[x]) for x in nodes), *[None] * len(a)], pa.int64())], names=["a", "b", "links"])


def summed(nodes: np.ndarray, weights: np.ndarray) -> tuple[list, list]:
    names, at = np.unique(nodes, return_inverse=True)
    return names.tolist(), np.bincount(at, weights.astype(float), len(names)).astype(np.int64).tolist()


def linked(placed: DataFrame, threshold: float, blocks: int, probes: int, scale: float, homes: int = 1024, asking: int = 8192) -> DataFrame:
    """``(a, b, links)``: with ``b`` null, a number of links of node ``a`` (to be added up), else a link that holds
    components together, of cosine ``threshold`` or more.

    A crowded cell becomes a grid of blocks: its home rows are cut into parts of about ``homes``, its
    asking rows into parts of about ``asking``, and every part meets every part of the other kind
    in a task of its own, so no cell has to fit one task and none of its pairs is left out.
    """
    crowd = placed.groupBy("bucket").agg(F.count_if(~F.col("asks")).alias("h"), F.count("*").alias("q")).filter((F.col("h") > 0) & ((F.col("h") > homes) | (F.col("q") > asking)))
    crowd = crowd.select("bucket", F.ceil(F.col("h") / homes).cast("int").alias("nh"), F.ceil(F.col("q") / asking).cast("int").alias("nq"))
    rows = placed.join(crowd, "bucket", "left").withColumns({"nh": F.coalesce("nh", F.lit(1)), "nq": F.coalesce("nq", F.lit(1))})
    pick = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_ = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    held = ("bucket", "table", "size", "asks", "node", "n", "data")
    # kind 0: home rows to be met; kind 1: rows that meet them (askers, and the home rows themselves)
    waits = rows.filter(~F.col("asks")).select(*held, F.lit(0).alias("kind"), F.explode(F.transform(all_("nq"), lambda j: F.struct(pick("nh").alias("i"), j.alias("j")))).alias("g"))
    meets = rows.select(*held, F.lit(1).alias("kind"), F.explode(F.transform(all_("nh"), lambda i: F.struct(i.alias("i"), pick("nq").alias("j")))).alias("g"))
    dealt = waits.unionByName(meets).select("bucket", "table", "size", "g.i", "g.j", "kind", "asks", "node", "n", "data").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "table", "size", "i", "j", "kind")

    def verify(batches):
        key, meeting = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True))
            asks, nodes, weights, data = (batch.column(c).to_pylist() for c in range(6, 10))
            start = 0
            for at in range(1, len(keys) + 1):
                if at < len(keys) and keys[at] == keys[start] and at - start < 1024:
                    continue
                if keys[start][:5] != key:
                    if meeting:
                        yield from meeting.rows()
                    key = keys[start][:5]
                    meeting = Meeting(key[1], key[2], threshold, blocks, probes, scale)
                if keys[start][5] == 0:
                    meeting.wait(nodes[start:at], weights[start:at], data[start:at])
                else:
                    meeting.meet(nodes[start:at], asks[start:at], weights[start:at], data[start:at])
                start = at
        if meeting:
            yield from meeting.rows()

    return dealt.mapInArrow(verify, "a string, b string, links long")


def near_duplicates(spark: SparkSession, rows: DataFrame, threshold: float = 0.95, blocks: int = 1, scale: float = SCALE) -> DataFrame:
    """``rows(vec_id, embedding)`` -> ``(vec_id, n_links, component_id, kept)``, one row each.

    Equal vectors are one node; different ones are compared where one's home cell or a
    neighbouring cell holds the other, in several random projections decoded to E8, and a
    link needs cosine ``threshold`` in double precision. The cells' size follows the number of components. Whether two vectors meet depends on
    the two alone, whatever else is in the table. More E8 ``blocks`` in a cell's name, with more tables and cells asked
    (``TABLES``), let fewer unlike vectors meet and move more copies; they are the caller's choice. Pairs at the
    threshold may be missed, a few in a hundred; nothing below the threshold is linked.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing
    (n_links 0, their own component). Vectors of different lengths never link. Repeated rows
    count as links of one another. A null vec_id is linked but names no component and is
    not kept. Empty tables give no rows; further columns are ignored.
    """
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fit = usable(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    whole = staged(spark, base.select("vec_id", F.when(fit, F.col("v")).alias("v"), F.when(fit, F.md5(F.array_join(F.transform("v", lambda x: (x + 0.0).cast("string")), ",").cast("binary"))).alias("hash")), "vectors")
    # a node's name begins with its smallest id, so that a component's smallest name tells its smallest id
    shifted = F.coalesce((F.col("lowest").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), F.lit("9" * 20))
    nodes = whole.filter(F.col("hash").isNotNull()).groupBy("hash", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("lowest"))
    nodes = staged(spark, nodes.select("hash", "v", "n", F.concat(F.lpad(shifted, 20, "0"), "hash").alias("node")), "nodes")
    tables, probes = TABLES[blocks]
    found = staged(spark, linked(place(nodes, blocks, tables, probes, scale), threshold, blocks, probes, scale), "found")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = connected_components(spark, found.filter("b IS NOT NULL").select("a", "b"))
    named = F.substring(F.coalesce("root", "node"), 1, 20)
    lowest = F.when(named != "9" * 20, (named.cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long"))
    members = nodes.select("hash", "n", "node").join(counts, "node", "left").join(roots, "node", "left").select("hash", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), lowest.alias("component_id"))
    out = whole.join(staged(spark, members, "members"), "hash", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("hash").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
