"""Operator 9: exact top-k inner products by best-first search of M-trees."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadveil.llm.common import staged
from roadveil.llm.vectors import matrices, usable

FOUND = "query_id long, vec_id long, score long"


class MTree:
    """Pages over the rows of one shard, bulk-loaded from the top.

    Rows are lifted to one sphere, ``x' = (x, sqrt(M^2 - |x|^2))``, where the nearest to
    ``q' = (q, 0)`` has the largest inner product with q. An inner page has routing objects with covering radii, a
    leaf page has rows; either has the stored distance of every entry to the page's own routing object.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, top: float, page: int = 512, fan: int = 16, seed: int = 5):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.top = ids[order], rows[order], top
        self.slack = 1e-6 * (1 + math.sqrt(top))
        self.computed = self.spared = 0
        lifted, rng = lift(self.rows, top), np.random.default_rng(seed)
        #: per page: rows, their numbers and None, or routers, radii and children; then the entries' distances to the parent
        self.pages: list[tuple] = []
        whole = np.arange(len(ids))
        self.root, work = 0, [(whole, lifted[:1][0] if len(ids) else None, -1, -1)]
        while work:
            part, router, parent, slot = work.pop()
            here = len(self.pages)
            if parent >= 0:
                self.pages[parent][2][slot] = here
            away = np.sqrt(((lifted[part] - router) ** 2).sum(1)) if len(part) else np.empty(0)
            groups = []
            if len(part) > page:
                pivots = lifted[part[np.sort(rng.permutation(len(part))[: min(fan, -(-len(part) // page))])]]
                owner, _ = nearest(lifted[part], pivots)
                groups = [(part[owner == p], pivots[p]) for p in range(len(pivots)) if (owner == p).any()]
            if len(groups) < 2:  # few rows, or copies of one vector
                sort = np.argsort(away, kind="stable")
                self.pages.append((self.rows[part[sort]], part[sort], None, away[sort]))
                continue
            routers = np.array([p for _, p in groups])
            radii = np.array([np.sqrt(((lifted[own] - p) ** 2).sum(1).max()) for own, p in groups])
            self.pages.append((routers, radii, [0] * len(groups), np.sqrt(((routers - router) ** 2).sum(1))))
            work += [(own, p, here, k) for k, (own, p) in enumerate(groups)]
        self.router = lifted[0] if len(ids) else None
        self.rows = None  # the pages hold them

    def search(self, query_id: int, query: np.ndarray, k: int, floor: float = -math.inf) -> list[tuple[int, int]]:
        """The k best (score, vec_id) of at least ``floor``, ties to smaller ids, without the query's own id."""
        if not len(self.ids):
            return []
        own = float(query @ query)
        lifted = np.append(query, 0.0)
        best: list[tuple[int, int]] = []  # heap of (score, -vec_id)
        slack = self.slack + 1e-6 * math.sqrt(own)

        def reach() -> float:
            """No row farther than this can be among the best."""
            least = best[0][0] if len(best) == k else floor
            return math.inf if least == -math.inf else math.sqrt(max(0.0, own + self.top - 2 * max(least, floor))) + slack

        queue = [(0.0, 0, math.sqrt(((self.router - lifted) ** 2).sum()))]
        while queue:
            bound, at, distance = heapq.heappop(queue)
            limit = reach()
            if bound > limit:
                break
            routers, entries, children, to_parent = self.pages[at]
            if children is not None:
                # the stored distance to the parent bounds a child before its own is computed
                kept = np.flatnonzero(np.abs(distance - to_parent) - entries <= limit)
                self.spared += len(entries) - len(kept)
                self.computed += len(kept)
                away = np.sqrt(((routers[kept] - lifted) ** 2).sum(1))
                for i, d in zip(kept.tolist(), away.tolist(), strict=True):
                    low = max(0.0, d - entries[i])
                    if low <= limit:
                        heapq.heappush(queue, (low, children[i], d))
                continue
            if limit < math.inf:
                span = slice(*np.searchsorted(to_parent, [distance - limit, distance + limit]))
                self.spared += len(entries) - (span.stop - span.start)
                entries, routers = entries[span], routers[span]
            self.computed += len(entries)
            scores = routers @ query
            near = scores >= max(floor, best[0][0] if len(best) == k else -math.inf)
            for score, i in zip(scores[near].astype(np.int64).tolist(), self.ids[entries[near]].tolist(), strict=True):
                if i == query_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
        return [(s, -i) for s, i in best]


def lift(rows: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([rows, np.sqrt(np.maximum(top - (rows * rows).sum(1), 0))[:, None]], 1)


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre and the distance to it, in slices."""
    owner, distance = np.empty(len(points), np.int64), np.empty(len(points))
    square = (centres * centres).sum(1)
    for at in range(0, len(points), 2048):
        part = points[at : at + 2048]
        owner[at : at + 2048] = (square[None] - 2 * part @ centres.T).argmin(1)
        distance[at : at + 2048] = np.sqrt(((part - centres[owner[at : at + 2048]]) ** 2).sum(1))
    return owner, distance


def homes(whole: DataFrame, pivots, top: float) -> DataFrame:
    """The rows with their nearest pivot (-1 if none has their length) and the distance to it."""

    def run(batches):
        for b in batches:
            pivot, away = np.full(b.num_rows, -1, np.int64), np.zeros(b.num_rows)
            for picked, rows in matrices(b.column(1)):
                if centres := pivots.value.get(rows.shape[1]):
                    owner, far = nearest(lift(rows, top), centres[1])
                    pivot[picked], away[picked] = centres[0][owner], far
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(pivot), pa.array(away)], names=["id", "v", "asks", "pivot", "away"])

    return whole.select("id", "v", "asks").mapInArrow(run, "id long, v array<double>, asks boolean, pivot long, away double")


def asked(queries: DataFrame, pivots, radii, top: float) -> DataFrame:
    """One row for every shard that a query can't rule out by its pivot's covering radius and the score that the query
    has found at home."""

    def run(batches):
        for b in batches:
            out: list[list] = [[], []]
            floors = b.column(2).to_numpy(zero_copy_only=False)
            for picked, rows in matrices(b.column(1)):
                names, centres = pivots.value.get(rows.shape[1], (np.array([-1]), None))
                reach = np.sqrt(np.maximum(0.0, (rows * rows).sum(1) + top - 2 * floors[picked]))
                for at in range(0, len(rows), 1024):
                    part = np.concatenate([rows[at : at + 1024], np.zeros((len(rows[at : at + 1024]), 1))], 1)
                    if centres is None:
                        hit = np.ones((len(part), 1), bool)
                    else:
                        far = np.sqrt(np.maximum(0.0, (part * part).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2 * part @ centres.T))
                        hit = far - radii.value[names] <= reach[at : at + 1024, None] + 1e-6 * (1 + math.sqrt(top) + far)
                    i, j = np.nonzero(hit)
                    out[0].append(picked[at + i])
                    out[1].append(names[j])
            which = pa.array(np.concatenate([*out[0], []]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), b.column(1).take(which), b.column(2).take(which), pa.array(np.concatenate([*out[1], []]).astype(np.int64))], names=["id", "v", "floor", "pivot"])

    return queries.select("id", "v", "floor").mapInArrow(run, "id long, v array<double>, floor double, pivot long")


def searched(index: DataFrame, queries: DataFrame, k: int, top: float) -> DataFrame:
    """Meets ``index(id, v)`` and ``queries(id, v, floor)`` of equal ``size, pivot, part, block``: the rows of a group build
    a tree once, and the queries stream past it."""
    keys = ("size", "pivot", "part", "block")
    both = index.select(*keys, F.lit(False).alias("asks"), "id", "v", F.lit(0.0).alias("floor")).unionByName(queries.select(*keys, F.lit(True).alias("asks"), "id", "v", "floor"))
    dealt = both.repartition(*keys).sortWithinPartitions(*keys, "asks")

    def run(batches):
        key, ids, rows, tree = None, [], [], None
        for b in batches:
            names = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            change = np.zeros(b.num_rows, bool)
            for n in names:
                change[1:] |= n[1:] != n[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            out: list[tuple[int, int, int]] = []
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                now, size = tuple(int(n[i]) for n in names[:4]), int(names[0][i])
                if now != key:
                    key, ids, rows, tree = now, [], [], None
                own, matrix = b.column(5)[i:j].to_numpy(), b.column(6)[i:j].flatten().to_numpy().reshape(-1, size)
                if not names[4][i]:
                    ids.append(own)
                    rows.append(matrix)
                    continue
                if tree is None and ids:
                    tree = MTree(np.concatenate(ids), np.concatenate(rows), top)
                if tree is not None:
                    for q, v, floor in zip(own.tolist(), matrix, b.column(7)[i:j].to_pylist(), strict=True):
                        out += [(q, x, s) for s, x in tree.search(q, v, k, floor)]
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, FOUND)


def top_k(spark: SparkSession, rows: DataFrame, is_query: Column, k: int = 20, shard_rows: int = 8192, block: int = 65536, scale: float = 64.0, most_pivots: int = 1024) -> DataFrame:
    """``rows(vec_id, embedding)`` -> ``(query_id, rank, vec_id, score)``.

    Components become ``floor(scale * x)``; the score is their inner product, exact below
    2^53. Every usable row is at home with the nearest of a bounded number of pivots; the rows of a pivot are dealt by
    hash to shards of about ``shard_rows``, each an M-tree of its own. A query first searches one shard
    at home, then, with the score of its k-th row in hand, all shards whose pivot's covering radius does not
    rule them out, in blocks of queries; the shards' best are merged. Neither memory nor a task's rows grow with the tables. Vectors that
    are null, empty or hold a null or non-finite component take no part; vectors of different
    lengths never meet; repeated rows are candidates as often as they occur, and a repeated query is asked as often (its
    rows are ranked together); rows with a null id are no candidates. Ties go to the smaller id, fewer rows than k give all.
    """
    whole = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    whole = whole.filter(F.col("id").isNotNull() & usable(F.col("v"))).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"), F.coalesce("asks", F.lit(False)).alias("asks"))
    whole = staged(spark, whole, "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, top = whole.agg(F.count("*"), F.coalesce(F.max(norm), F.lit(0.0))).first()
    wanted = min(most_pivots, max(1, -(-total // shard_rows)))
    picked = whole.orderBy(F.xxhash64("id", "v"), "id").limit(wanted).select("v").collect()  # at most ``most_pivots`` rows
    by_size: dict[int, list] = {}
    for i, r in enumerate(picked):
        by_size.setdefault(len(r[0]), []).append((i, r[0]))
    pivots = spark.sparkContext.broadcast({n: (np.array([i for i, _ in own]), lift(np.array([v for _, v in own], float), top)) for n, own in by_size.items()})
    at_home = staged(spark, homes(whole, pivots, top).withColumn("size", F.size("v")), "homes")
    shards = staged(spark, at_home.groupBy("size", "pivot").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"), F.max("away").alias("radius")), "shards")
    reach = np.full(wanted + 1, -1.0)  # the last for rows without a pivot, which are never left out
    for r in shards.filter("pivot >= 0").collect():  # one row a pivot
        reach[r["pivot"]] = r["radius"]
    radii = spark.sparkContext.broadcast(reach)

    pick = lambda n, seed: F.pmod(F.xxhash64("id", "v", F.lit(seed)), F.col(n) if isinstance(n, str) else F.lit(n)).cast("int")
    index = at_home.join(shards.select("size", "pivot", "parts"), ["size", "pivot"]).withColumn("part", pick("parts", 1))
    index = staged(spark, index.select("size", "pivot", "part", "parts", "id", "v", "asks"), "index")
    n_blocks = max(1, -(-index.filter("asks").count() // block))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    spread = index.select("size", "pivot", "part", "id", "v", blocks)
    first = index.filter("asks").select("size", "pivot", "part", "id", "v", F.lit(float("-inf")).alias("floor"), pick(n_blocks, 2).alias("block"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = searched(spread, first, k, top).select("query_id", "score", F.row_number().over(order).alias("rank")).filter(F.col("rank") == k)
    floors = found.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    queries = index.filter("asks").select("id", "v").join(floors, "id", "left").select("id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    wide = asked(staged(spark, queries, "queries"), pivots, radii, top).withColumn("size", F.size("v")).join(shards.select("size", "pivot", "parts"), ["size", "pivot"])
    wide = wide.select("size", "pivot", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "v", "floor", pick(n_blocks, 2).alias("block"))
    best = searched(spread, wide, k, top)
    return best.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
