"""Collections of features: one JSON document of any size, written by all tasks and read in parts.

A reader that starts in the middle of a document does not know whether it is within a text or how deep. So each part is
looked through once for both cases; a running total over the parts, one row each, tells which one holds, and then every task finds the
features that begin in its own part.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from roadveil.operators.prefix import running
from roadveil.operators.staging import staged
from roadveil.sources.graphfile import CHUNK, GraphFile

HEAD, TAIL = b'{"type":"FeatureCollection","features":[', b"\n]}\n"
#: bytes looked at together
BLOCK = 1 << 20
#: objects in a list of the outermost object begin at this depth
FEATURE_DEPTH = 2
QUOTE, SLASH = ord('"'), ord("\\")
STEPS = np.zeros(256, np.int8)
STEPS[list(b"{[")], STEPS[list(b"}]")] = 1, -1


def write_features(spark: SparkSession, found: DataFrame, order: list[str], path: str) -> int:
    """The ``feature`` texts of ``found`` as a FeatureCollection in the order of unique keys; returns the file's bytes. ``path`` lies in a mounted
    folder that all executors share; tasks write their features at the places that running totals give, and the file gets its name at the end.
    Null features are left out."""
    there = found.filter("feature IS NOT NULL").select(*order, F.encode("feature", "UTF-8").alias("feature"))
    placed, sums = running(spark, there, order, {"at": F.length("feature") + 2})
    lead = F.when(F.col("at") == 0, F.lit(b" \n")).otherwise(F.lit(b",\n"))
    pieces = placed.select((F.col("at") + len(HEAD)).alias("at"), F.concat(lead, "feature").alias("data"))
    joined = pieces.sortWithinPartitions("at").mapInArrow(neighbours, CHUNK)
    ends = [(0, bytearray(HEAD)), (len(HEAD) + sums["at"], bytearray(TAIL))]
    size = len(HEAD) + sums["at"] + len(TAIL)
    spark.dataSource.register(GraphFile)
    joined.unionByName(spark.createDataFrame(ends, CHUNK)).write.format("roadveil_graph").mode("overwrite").option("size", size).option("filled", size).save(path)
    return size


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch that follow each other in the file as one."""
    for batch in batches:
        out: list[tuple[int, list[bytes], int]] = []
        for at, data in zip(batch.column("at").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if out and out[-1][2] == at:
                out[-1] = (out[-1][0], out[-1][1], at + len(data))
                out[-1][1].append(data)
            else:
                out.append((at, [data], at + len(data)))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([b"".join(o[1]) for o in out], pa.binary())], names=["at", "data"])


def signs(block: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of quotes that begin or end texts, places of brackets, and whether the byte behind the block is escaped."""
    quotes, brackets = np.flatnonzero(block == QUOTE), np.flatnonzero(STEPS[block])
    slashes = block == SLASH
    if not slashes.any():
        return (quotes[1:] if escaped and len(quotes) and quotes[0] == 0 else quotes), brackets, False
    at = np.arange(len(block))
    other = np.maximum.accumulate(np.where(slashes, -1, at))  # the last byte up to here that is none
    run = np.where(slashes, at - other + (other < 0) * int(escaped), 0)
    before = np.where(quotes > 0, run[quotes - 1], int(escaped))
    return quotes[before % 2 == 0], brackets, bool(run[-1] % 2)


def blocks(f, at: int, end: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(place, bytes, quotes, brackets)`` from ``at`` on."""
    back, escaped = at, False
    while back and os.pread(f.fileno(), 1, back - 1) == b"\\":
        back, escaped = back - 1, not escaped
    while at < end:
        block = np.frombuffer(os.pread(f.fileno(), min(BLOCK, end - at), at), np.uint8)
        if not len(block):
            raise OSError(f"{f.name} became shorter")
        quotes, brackets, escaped = signs(block, escaped)
        yield at, block, quotes, brackets
        at += len(block)


def summed(path: str, size: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for batch in batches:
                for part in batch.column("part").to_pylist():
                    odd, steps = 0, [0, 0]
                    for _, block, quotes, brackets in blocks(f, part * span, min(size, (part + 1) * span)):
                        within = (np.searchsorted(quotes, brackets) + odd) % 2
                        taken = STEPS[block[brackets]].astype(np.int64)
                        steps = [steps[case] + int(taken[within == case].sum()) for case in (0, 1)]
                        odd = (odd + len(quotes)) % 2
                    yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (part, odd, *steps)], names=["part", "odd", "outside", "inside"])

    return run


def cut(path: str, size: int, span: int):
    def features(f, part: int, odd: int, depth: int) -> Iterator[bytes]:
        held, behind = None, (part + 1) * span  # bytes of a feature that has begun
        for at, block, quotes, brackets in blocks(f, part * span, size):
            places = brackets[(np.searchsorted(quotes, brackets) + odd) % 2 == 0]
            steps = STEPS[block[places]].astype(np.int64)
            deep = depth + np.cumsum(steps)
            if (deep < 0).any():
                raise ValueError(f"{f.name}: a bracket ends what has not begun")
            edge = np.flatnonzero(((deep == FEATURE_DEPTH + 1) & (steps > 0) & (block[places] == ord("{"))) | ((deep == FEATURE_DEPTH) & (steps < 0)))
            begun = 0
            for e in edge.tolist():
                place = int(places[e])
                if steps[e] > 0:
                    if at + place >= behind:
                        return
                    held, begun = [], place
                elif held is not None:
                    yield b"".join([*held, block[begun : place + 1].tobytes()])
                    held = None
            if held is not None:
                held.append(block[begun:].tobytes())
            elif at + len(block) >= behind and at + len(block) < size:
                return
            depth, odd = depth + int(steps.sum()), (odd + len(quotes)) % 2
        if odd or depth:
            raise ValueError(f"{f.name} ends before its last bracket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(path, "rb") as f:
            for batch in batches:
                for part, odd, depth in zip(*(batch.column(c).to_pylist() for c in ("part", "odd", "depth")), strict=True):
                    some, held = [], 0
                    for feature in features(f, part, odd, depth):
                        some.append(feature)
                        held += len(feature)
                        if held > 4 * BLOCK:
                            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()).cast(pa.string())], names=["feature"])
                            some, held = [], 0
                    if some:
                        yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()).cast(pa.string())], names=["feature"])

    return run


def read_features(spark: SparkSession, path: str, span: int = 32 << 20) -> DataFrame:
    """``(feature)``: the texts of a collection's features, a task for every ``span`` bytes. One feature must fit a task, the document need not.

    Blanks, line ends and members before and behind the features are as they come. Objects in other lists of the outermost
    object are features, too, if they say so. A document that ends early or has a bracket too many fails.
    """
    size = os.path.getsize(path)
    n = -(-size // span)
    states = spark.range(0, n, 1, max(1, n)).select(F.col("id").alias("part")).mapInArrow(summed(path, size, span), "part long, odd long, outside long, inside long")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    known = states.withColumn("o", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)))
    known = known.withColumn("depth", F.coalesce(F.sum(F.when(F.col("o") == 0, F.col("outside")).otherwise(F.col("inside"))).over(before), F.lit(0)))
    parts = staged(spark, known.select("part", F.col("o").cast("long").alias("odd"), F.col("depth").cast("long").alias("depth")), "parts")
    found = parts.repartitionByRange(max(1, n), "part").mapInArrow(cut(path, size, span), "feature string")
    return found.filter(F.get_json_object("feature", "$.type") == "Feature")


def ring_points(found: DataFrame, key: Column) -> DataFrame:
    """Polygons' texts -> ``(bid, n, x, y)``: the points of their outer rings, numbered from 1; holes and other geometries give none."""
    shape = F.from_json("feature", "geometry struct<type: string, coordinates: array<array<array<double>>>>, properties map<string, string>")
    polygons = found.withColumn("f", shape).filter("f.geometry.type = 'Polygon' AND size(f.geometry.coordinates) > 0")
    each = polygons.select(key.alias("bid"), F.posexplode(F.col("f.geometry.coordinates")[0]).alias("n", "p"))
    return each.select("bid", (F.col("n") + 1).cast("long").alias("n"), F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
