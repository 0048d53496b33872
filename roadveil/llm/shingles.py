"""Exact groups of texts whose 5-word shingle sets have a Jaccard similarity of 0.8 or more.

By prefixes: with one order over all shingles, two sets of similarity 4/5 share one of the
first ``n - ceil(4 n / 5) + 1`` shingles of either, so none is lost whatever the data. The order goes by
how often shingles come in all texts, rarest first, as told by a table of tallies of fixed size; where the first shingle that two texts
share stands in either bounds how many they can share at all. A coarse tally costs candidates and has no effect on
results. Every link is verified on the whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from roadveil.llm.common import raw_bytes, staged
from roadveil.llm.components import connected_components
from roadveil.llm.recent import release

WORDS = 5
#: tallies of shingles, and slices in which tasks hand them over
CELLS, SLICES = 1 << 24, 256
MOST_TOLD = (1 << 32) - 1
#: classes of tokens, at least, whose parities stand for a set; keys that are sent to every task at most
BITS = 2048
MOST_SENT = 500_000


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted hashes of the different runs of five words (of all words, if fewer)."""
    words = text.lower().split()
    runs = zip(*(words[k:] for k in range(WORDS)), strict=False) if len(words) > WORDS else [words]
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(r), 5) for r in runs], np.uint64).view(np.int64))


def text_key(text: bytes) -> int:
    """Texts of the same words are one node."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 6)


@F.arrow_udf(LongType())
def keys(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([text_key(raw_bytes(t)) for t in texts], np.uint64).view(np.int64))


@F.arrow_udf(BooleanType())
def alike(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = x.values.to_numpy(), y.values.to_numpy()
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(5 * both >= 4 * (len(x) + len(y) - both))
    return pa.array(out, pa.bool_())


def parities(tokens: np.ndarray) -> bytes:
    """Of every class of tokens whether the set has an odd number. There are ``BITS`` classes, doubled until a set has no more
    tokens than classes, as the parities of few classes tell large sets apart by nothing."""
    classes = max(BITS, 1 << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & (classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def odd_apart(a: bytes, b: bytes) -> int:
    """Parities that differ. Halves of the longer are folded first: a class is two of twice as many classes."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


@F.arrow_udf(BooleanType())
def may_be_alike(n: pa.Array, m: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    """False only where two sets can't be similar: two that are differ in at most a ninth of the sum of their sizes,
    and in at least as many tokens as parities."""
    n, m = n.to_numpy(), m.to_numpy()
    out = 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)
    for i in np.flatnonzero(out).tolist():
        out[i] = 9 * odd_apart(a[i].as_py(), b[i].as_py()) <= n[i] + m[i]
    return pa.array(out, pa.bool_())


def sets(texts: DataFrame, wanted=None) -> DataFrame:
    """``texts(text)`` -> ``(key, odd, tokens)``, each key once a task; of the keys in ``wanted`` alone, a sorted array sent to all tasks, if there is one."""

    def run(batches):
        seen = set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                found = {text_key(t): t for t in map(raw_bytes, b.column(0)[at : at + 256])}
                new = [k for k in found if k not in seen]
                if wanted is not None:
                    new = np.array(new, np.uint64)[np.isin(np.array(new, np.uint64).view(np.int64), wanted.value)].tolist()
                seen.update(new)
                if len(seen) > 1 << 16:
                    seen.clear()
                made = [shingle_set(found[k]) for k in new]
                ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *made])))
                odd = pa.array([parities(m) for m in made], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.array(new, np.uint64).view(np.int64)), odd, tokens], names=["key", "odd", "tokens"])
        release()

    return texts.mapInArrow(run, "key long, odd binary, tokens array<long>")


def tallies(spark: SparkSession, texts: DataFrame) -> np.ndarray:
    """How often the shingles of each of ``CELLS`` classes come in all texts, copies once a task; never less than any shingle of the class does, up to 255 a task.

    A task hands over its table in slices, which are added up one after the other: a task holds one table, whatever
    the number of tasks, and the driver gets one.
    """
    width = CELLS // SLICES

    def count(batches):
        table, done = np.zeros(CELLS, np.uint8), set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                found = {text_key(t): t for t in map(raw_bytes, b.column(0)[at : at + 256])}
                new = [shingle_set(t) for k, t in found.items() if k not in done]
                done.update(found)
                if len(done) > 1 << 16:
                    done.clear()
                cells, times = np.unique(np.concatenate([np.empty(0, np.int64), *new]) & (CELLS - 1), return_counts=True)
                table[cells] = np.minimum(table[cells] + times, 255)
        for k in np.flatnonzero(table.reshape(SLICES, width).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([table[k * width : (k + 1) * width].tobytes()])], names=["slice", "table"])
        release()

    def add(batches):
        sums = {}
        for b in batches:
            for k, part in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(part.as_py(), np.uint8).astype(np.int64)
        for k, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([np.minimum(part, MOST_TOLD).astype(np.uint32).tobytes()])], names=["slice", "table"])

    form = "slice int, table binary"
    out = np.zeros((SLICES, width), np.uint32)
    for k, part in texts.mapInArrow(count, form).repartition("slice").mapInArrow(add, form).toLocalIterator():
        out[k] = np.frombuffer(part, np.uint32)
    return out.ravel()


def ranks(table: np.ndarray) -> np.ndarray:
    """By class: 0 where its tally is one at most, so no two texts share a shingle of it, else 1 and more by how far, in octaves, the tally is above what
    chance puts into a class."""
    mean, out = table.mean(), np.empty(len(table), np.uint8)
    for at in range(0, len(table), 1 << 16):
        part = table[at : at + (1 << 16)]
        out[at : at + (1 << 16)] = np.where(part <= 1, 0, 1 + np.log2(1 + np.maximum(part - mean, 0) / (1 + np.sqrt(mean))))
    return out


def prefixes(spark: SparkSession, texts: DataFrame) -> DataFrame:
    """``(key, token, n, at)``: of the ``n`` shingles of a text, rarest first, those of its prefix that another may have too, and how many
    stand before. Copies of a text come once a task."""
    rank = spark.sparkContext.broadcast(ranks(tallies(spark, texts)))

    def run(batches):
        done = set()
        for b in batches:
            for at in range(0, b.num_rows, 256):
                names, sizes, tokens, places = [], [], [], []
                for t in map(raw_bytes, b.column(0)[at : at + 256]):
                    key = text_key(t)
                    if key in done:
                        continue
                    done.add(key)
                    own = shingle_set(t)
                    level = rank.value[own & (CELLS - 1)]
                    order = np.argsort(level, kind="stable")[: len(own) // 5 + 1]
                    alone = int(np.searchsorted(level[order], 1))
                    names.append(key)
                    sizes.append(len(own))
                    tokens.append(own[order[alone:]])
                    places.append(np.arange(alone, len(order)))
                if len(done) > 1 << 16:
                    done.clear()
                if names:
                    many = [len(t) for t in tokens]
                    columns = np.repeat(np.array(names, np.uint64).view(np.int64), many), np.concatenate(tokens), np.repeat(sizes, many), np.concatenate(places)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "token", "n", "at"])
        release()

    return texts.mapInArrow(run, "key long, token long, n long, at long")


def may_share(n: Column, at: Column, m: Column, by: Column) -> Column:
    """False where two sets of ``n`` and ``m``, whose first common shingle has ``at`` and ``by`` before it, can't be similar: they have no more in common
    than stands from there on, and two that are have four ninths of the sum of their sizes."""
    return (5 * F.least(n, m) >= 4 * F.greatest(n, m)) & (9 * F.least(n - at, m - by) >= 4 * (n + m))


def verified(spark: SparkSession, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of ``pairs(a, b)`` of keys those of similar texts; parities spare most of the sets."""
    pairs = staged(spark, pairs, "pairs")
    asked = staged(spark, pairs.select(F.col("a").alias("asked")).unionByName(pairs.select(F.col("b").alias("asked"))).distinct(), "asked")
    if asked.count() <= MOST_SENT:  # whole texts don't move for a list of keys that is small
        own = sets(texts, spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in asked.collect()], np.int64))))
    else:
        own = sets(texts.join(asked, keys("text") == asked["asked"], "left_semi").select("text"))
    own = staged(spark, own, "sets")
    marks = own.groupBy("key").agg(F.first(F.size("tokens").cast("long")).alias("n"), F.first("odd").alias("odd"))
    both = pairs.join(marks.toDF("a", "n", "x"), "a").join(marks.toDF("b", "m", "y"), "b")
    likely = staged(spark, both.filter(may_be_alike("n", "m", "x", "y")).select("a", "b"), "likely")
    needed = own.select("key", "tokens").dropDuplicates(["key"])
    met = likely.join(needed.toDF("a", "x"), "a").join(needed.toDF("b", "y"), "b")
    return staged(spark, met.filter(alike("x", "y")).select("a", "b"), "alike")


def components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs(text)`` -> ``(node, root)`` for the keys of texts that have a similar one.

    First every text meets one under each of its shared shingles, of about its size, which joins
    large groups by as many pairs as they have rows. Then the texts under a shingle that are
    still in different groups meet each other, all that may be similar by size and place; within a group no pair can change
    anything.
    """
    texts = docs.select(docs["text"].cast("string").alias("text"))
    first = staged(spark, prefixes(spark, texts), "prefixes")
    shared = first.groupBy("token").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("token")
    found = staged(spark, first.join(shared, "token").withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25)))), "shared")
    lead = found.groupBy("token", "band").agg(F.min(F.struct("at", "n", "key")).alias("lead"), F.count("*").alias("texts")).filter("texts > 1")
    star = found.join(lead, ["token", "band"]).filter((F.col("key") != F.col("lead.key")) & may_share(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at")))
    ends = F.least("key", "lead.key").alias("a"), F.greatest("key", "lead.key").alias("b")
    links = verified(spark, texts, star.select(*ends).distinct())
    roots = connected_components(spark, links)
    named = found.join(roots, found["key"] == roots["node"], "left").select("token", "key", "n", "at", F.coalesce("root", "key").alias("root"))
    named = staged(spark, named, "named")
    mixed = named.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("token")
    mixed = staged(spark, named.join(mixed, "token"), "mixed")
    a, b = mixed.alias("a"), mixed.alias("b")
    near = may_share(F.col("a.n"), F.col("a.at"), F.col("b.n"), F.col("b.at"))
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.root") < F.col("b.root")) & near)
    more = verified(spark, texts, met.select(F.col("a.key").alias("a"), F.col("b.key").alias("b")).distinct())
    return staged(spark, connected_components(spark, links.unionByName(more)), "roots")
