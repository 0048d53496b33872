"""Operator 1: SimHash near-duplicates through vantage-point shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from roadveil.llm import shingles
from roadveil.llm.common import raw_bytes, staged
from roadveil.llm.components import connected_components, forest
from roadveil.llm.recent import release

RADIUS = 3
HALF = 32
#: fingerprints at home in a shard, about; fingerprints in the sample that shapes the shards, at most
SHARD, SAMPLE = 8192, 65536
SEED = 42
LANES = np.uint64(0x0101010101010101)


def fingerprint(text: bytes, shingle: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash: bit i is set if more than half of the shingles' hashes have it."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    counts, total = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, total, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        if len(part) < shingle:
            hashes = np.array([digest(join(part), seed)], np.uint64)
        else:
            runs = zip(*(part[k:] for k in range(shingle)), strict=False)
            hashes = np.array([digest(join(r), seed) for r in runs], np.uint64)
        # eight one-byte counters ride in each word; 255 hashes cannot overflow them
        padded = np.zeros(-(-len(hashes) // 255) * 255, np.uint64)
        padded[: len(hashes)] = hashes
        blocks = padded.reshape(-1, 255)
        for k in range(8):
            lanes = ((blocks >> np.uint64(k)) & LANES).sum(1, dtype=np.uint64)
            counts[k::8] += lanes.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    bits = counts * 2 > total
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    found = np.array([fingerprint(raw_bytes(t)) for t in texts], np.uint64).view(np.int64)
    release()
    return pa.array(found)


class VantageTree:
    """Binary vantage-point tree over 32-bit halves, nodes in the order of a heap.

    Node i has a vantage point, taken from the points below it, and the median of their distances to it as
    radius: points within the radius are below 2i, the others below 2i + 1. ``pruned`` counts the branches that the
    triangle bound has spared.
    """

    def __init__(self, points: np.ndarray, depth: int):
        self.depth, self.pruned = depth, 0
        self.points = np.zeros(1 << depth, np.uint32)
        self.radii = np.full(1 << depth, HALF, np.int16)
        points = points[np.argsort(mixed(points), kind="stable")]
        node = np.ones(len(points), np.int64)
        for _ in range(depth):
            order = np.argsort(node, kind="stable")
            held, first, size = np.unique(node[order], return_index=True, return_counts=True)
            self.points[held] = points[order[first]]
            away = np.bitwise_count(points ^ self.points[node]).astype(np.int16)
            ranked = away[np.lexsort((away, node))]
            self.radii[held] = ranked[first + (size - 1) // 2]
            node = 2 * node + (away > self.radii[node])

    def leaves(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf): the leaves that can hold a point within a row's radius. By the triangle
        inequality such a point is at d - radius to d + radius from the vantage point, so a branch that
        lies beyond is left out."""
        row, node = np.arange(len(points)), np.ones(len(points), np.int64)
        for _ in range(self.depth):
            away = np.bitwise_count(points[row] ^ self.points[node]).astype(np.int16)
            inner, outer = away - radius[row] <= self.radii[node], away + radius[row] > self.radii[node]
            self.pruned += int((~inner).sum() + (~outer).sum())
            row, node = np.concatenate([row[inner], row[outer]]), np.concatenate([2 * node[inner], 2 * node[outer] + 1])
        return row, node - (1 << self.depth)


def mixed(points: np.ndarray) -> np.ndarray:
    """An order of the points that has nothing to do with their distances."""
    z = points.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def half_of(prints: np.ndarray, which) -> np.ndarray:
    return ((prints.view(np.uint64) >> (np.uint64(HALF) * np.asarray(which, np.uint64))) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def reach(halves: np.ndarray) -> np.ndarray:
    """Two halves that differ by one bit have an even one, which asks; the odd one asks for its equals only."""
    return (np.bitwise_count(halves) % 2 == 0).astype(np.int16)


def place(prints: DataFrame, trees) -> DataFrame:
    """``(shard, asks, fp)``: every fingerprint at its own leaf, once a half, and where it has to ask."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            out = []
            for which, tree in enumerate(trees.value):
                half = half_of(fp, which)
                for asks, radius in ((False, np.zeros(len(fp), np.int16)), (True, reach(half))):
                    row, leaf = tree.leaves(half, radius)
                    out.append((2 * leaf + which, np.full(len(row), asks), fp[row]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["shard", "asks", "fp"])

    return prints.select("fp").mapInArrow(run, "shard long, asks boolean, fp long")


def search(homes: np.ndarray, asking: np.ndarray, which: int, leaf: int = 16, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs at ``RADIUS`` or fewer bits of fingerprints that ask and those at home in one shard, by a tree of
    the shard's own, a bounded number of candidates at a time."""
    half = half_of(homes, which)
    tree = VantageTree(half, max(0, math.ceil(math.log2(max(1, len(homes)) / leaf))))
    row, at = tree.leaves(half, np.zeros(len(half), np.int16))
    homes = homes[row[np.argsort(at, kind="stable")]]
    size = np.bincount(at, minlength=1 << tree.depth)
    start = np.cumsum(size) - size
    for begin in range(0, len(asking), 4096):
        part = asking[begin : begin + 4096]
        own = half_of(part, which)
        row, at = tree.leaves(own, reach(own))
        row, at = row[size[at] > 0], at[size[at] > 0]
        ends = np.cumsum(size[at])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(most, ends[-1] if len(ends) else 0, most)), [len(row)]]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            n = size[at[i:j]]
            place = np.repeat(start[at[i:j]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            x, y = part[np.repeat(row[i:j], n)], homes[place]
            near = (np.bitwise_count((x ^ y).view(np.uint64)) <= RADIUS) & (x != y)
            if near.any():
                yield x[near], y[near]


def near_pairs(spark: SparkSession, prints: DataFrame, shard_rows: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Links ``(a, b)`` that connect all different fingerprints ``fp`` at ``RADIUS`` or fewer bits, and none else.

    A fingerprint splits into two halves of 32 bits, so two within three bits are within one bit on some half.
    Each half has a vantage-point tree, whose points and radii come from a bounded sample of the
    fingerprints (a hash decides; the sample has an effect on the sizes of shards, not on what is found). Its
    leaves are the shards. A fingerprint is at home in one leaf and asks all leaves that
    the triangle bound can't rule out; in a shard, a tree of its own does the same, and the exact
    distance decides. A shard with too many fingerprints at home is split by hash into parts, each of which is asked.
    Of the pairs of a task only as many links go on as hold its components together.
    """
    total = prints.count()
    picked = prints.filter(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(1 << 20)) <= F.lit(int((1 << 20) * min(1.0, sample / max(1, total))))).select("fp").limit(2 * sample)
    known = np.sort(np.array([r[0] for r in picked.collect()], np.int64))  # at most 2 * sample numbers
    depth = max(0, min(math.ceil(math.log2(max(1, total) / shard_rows)), int(math.log2(max(1, len(known)))) - 2))
    trees = spark.sparkContext.broadcast([VantageTree(half_of(known, which), depth) for which in (0, 1)])
    placed = staged(spark, place(prints, trees), "placed")
    crowd = placed.filter("NOT asks").groupBy("shard").agg(F.ceil(F.count("*") / (4 * shard_rows)).cast("int").alias("parts")).filter("parts > 1")
    rows = placed.join(crowd, "shard", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))
    dealt = rows.select("shard", F.explode(part).alias("part"), "asks", "fp").repartition("shard", "part").sortWithinPartitions("shard", "part", "asks")

    def run(batches):
        key, homes, waiting, found = None, [], [], []

        def ask():
            if homes and waiting:
                found.extend(search(np.concatenate(homes), np.concatenate(waiting), key[0] % 2))
            waiting.clear()

        def links(least: int):
            if sum(len(x) for x, _ in found) > least:
                a, b = forest(*(np.concatenate(c) for c in zip(*found, strict=True)))
                found[:] = [(a, b)]
                if 2 * len(a) > least:
                    found.clear()
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            shard, piece, asks, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(piece) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), len(fp)], strict=True):
                if i == j:
                    continue
                if (shard[i], piece[i]) != key:
                    ask()
                    homes.clear()
                    key = (shard[i], piece[i])
                (waiting if asks[i] else homes).append(fp[i:j])
            if sum(map(len, waiting)) > 1 << 18:
                ask()
            yield from links(1 << 20)
        ask()
        yield from links(0)

    return dealt.mapInArrow(run, "a long, b long")


def grouped_prints(spark: SparkSession, prints: DataFrame) -> DataFrame:
    """``prints(doc_id, fp)`` -> ``(fp, lowest, root)``: each different fingerprint, the smallest id that has it, and the smallest fingerprint that links reach."""
    nodes = staged(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("lowest")), "nodes")
    roots = connected_components(spark, near_pairs(spark, nodes))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "lowest", F.coalesce("root", "fp").alias("root"))


def cluster(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, fp, component_id)``, one row a document.

    Equal fingerprints are one node from the start, so copies are never paired. A document
    without words (null or empty text too) has fingerprint zero and links like any other.
    Very long texts: whole, in slices. Repeated rows come back as often as they occur; a
    null doc_id is linked but never names a component (null if no other id is there).
    Further columns are ignored; an empty table gives no rows.
    """
    prints = staged(spark, docs.select(docs["doc_id"].cast("long").alias("doc_id"), fingerprints(docs["text"].cast("string")).alias("fp")), "prints")
    grouped = grouped_prints(spark, prints)
    named = grouped.groupBy("root").agg(F.min("lowest").alias("component_id"))
    members = staged(spark, grouped.select("fp", "root").join(named, "root").select("fp", "component_id"), "members")
    return prints.join(members, "fp", "left").select("doc_id", "fp", "component_id")


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``; see ``cluster``."""
    return cluster(spark, docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each component of texts at a 5-word Jaccard of 0.8 or more (see ``shingles``),
    all columns unchanged: the smallest id, with its text. Rows without an id stay. Null and empty texts are
    one group, of which one row stays; an empty table stays empty."""
    named = docs.withColumn("roadveil key", shingles.keys(docs["text"].cast("string")))
    ids = staged(spark, named.filter(docs["doc_id"].isNotNull()).groupBy(docs["doc_id"].cast("long").alias("doc_id"), F.col("roadveil key").alias("key")).agg(F.count("*").alias("times")), "ids")
    grouped = staged(spark, ids.join(shingles.components(spark, docs), ids["key"] == F.col("node"), "left").select("doc_id", "key", "times", F.coalesce("root", "key").alias("root")), "grouped")
    return firsts(spark, named, grouped)


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each component of fingerprints at ``RADIUS`` or fewer bits (see ``cluster``), all columns unchanged: the smallest id, with
    its text. Texts without words (null and empty ones too) have one fingerprint, so one row of them stays. Very long texts are
    read whole. Of rows equal in id and text one stays; rows without an id link others and stay. An empty table stays empty."""
    text = docs["text"].cast("string")
    named = docs.withColumn("roadveil key", F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    prints = staged(spark, named.select(docs["doc_id"].cast("long").alias("doc_id"), F.col("roadveil key").alias("key"), fingerprints(text).alias("fp")), "prints")
    members = staged(spark, grouped_prints(spark, prints).select("fp", "root"), "members")
    ids = prints.filter("doc_id IS NOT NULL").groupBy("doc_id", "key", "fp").agg(F.count("*").alias("times"))
    return firsts(spark, named, staged(spark, ids.join(members, "fp").select("doc_id", "key", "times", "root"), "grouped"))


def firsts(spark: SparkSession, named: DataFrame, grouped: DataFrame) -> DataFrame:
    """Of ``named``, documents with a ``roadveil key`` of their text, those that ``grouped(doc_id, key, times, root)`` has first in each group."""
    kept = grouped.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("one")).select("one.*")
    # few rows go, so the list of those is what meets the texts; of rows equal in id and text all go and one comes back
    gone = staged(spark, grouped.join(kept.withColumn("stays", F.lit(True)), ["doc_id", "key"], "left").filter("stays IS NULL OR times > 1").select(F.col("doc_id").alias("gone id"), F.col("key").alias("gone key"), F.coalesce("stays", F.lit(False)).alias("again")), "gone")
    sent = (lambda rows: F.broadcast(rows)) if gone.count() <= shingles.MOST_SENT else (lambda rows: rows)
    same = (named["doc_id"].cast("long") == F.col("gone id")) & (named["roadveil key"] == F.col("gone key"))
    rest = named.join(sent(gone), same, "left_anti")
    again = named.join(sent(gone.filter("again")), same, "left_semi").dropDuplicates(["doc_id", "roadveil key"])
    return rest.unionByName(again).drop("roadveil key")
