"""Streams with state against their forms for tables: files come one a batch."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from roadveil.sources.network import derived
from roadveil.streaming import live

SF = "/root/testdata/sf0.001"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, before)


def streamed(spark, parts, make, name):
    """Rows of ``make(stream)`` when each of ``parts`` is a batch, one after the other."""
    folder, kept = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
        query = make(spark.readStream.schema(part.schema).parquet(folder)).writeStream.format("parquet").option("checkpointLocation", f"{kept}/at").trigger(availableNow=True).outputMode("append").start(f"{kept}/{name}")
        query.awaitTermination(300)
        assert query.exception() is None
        query.stop()
    return sorted(map(tuple, spark.read.parquet(f"{kept}/{name}").collect()), key=repr)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def thirds(spark, key="ts"):
    """Events in three parts by time, and one of a stranger long after, which moves the watermark."""
    events = live.positions(derived(spark, SF, "events"))
    cuts = events.approxQuantile("at_ms", [1 / 3, 2 / 3], 0.0)
    part = F.when(F.col("at_ms") < cuts[0], 0).when(F.col("at_ms") < cuts[1], 1).otherwise(2)
    parts = [events.filter(part == n) for n in range(3)]
    last = spark.sql("SELECT -1L AS user_id, -1L AS event_id, TIMESTAMP '2030-01-01 00:00:00' AS ts, 1893456000000L AS at_ms")
    return events, [*parts, last]


def test_pauses_of_a_stream_are_those_of_the_table(spark):
    events, parts = thirds(spark)
    found = streamed(spark, parts, lambda s: live.debounced(s.withWatermark("ts", "0 seconds")), "pauses")
    assert found == rows(live.debounced(events)) and len(found) > 100


def test_watched_positions_of_a_stream_are_those_of_the_table(rocks):
    events, parts = thirds(rocks)
    wait = 3_600_000
    found = [r for r in streamed(rocks, parts, lambda s: live.watched_stream(s, lost_after=wait), "watched") if r[0] >= 0]
    assert found == rows(live.watched(events, wait))
    assert {r[3] for r in found} == {"fix", "lost"}


def test_late_positions_are_passed_over_and_later_ones_dropped(rocks):
    def part(*fixes):
        return live.positions(rocks.createDataFrame(fixes, "user_id long, event_id long, s long").select("user_id", "event_id", F.timestamp_seconds("s").alias("ts")))

    # 1000 s + 20 s of grace: 990 is behind a newer one; after 1200 the watermark is 1180, so 1100 does not come at all
    parts = [part((1, 1, 1000)), part((1, 2, 990), (2, 3, 1010)), part((2, 4, 1200)), part((1, 5, 1100), (1, 6, 1205)), part((3, 7, 9000))]
    found = streamed(rocks, parts, lambda s: live.watched_stream(s, "20 seconds"), "late")
    assert [r for r in found if r[0] == 1] == sorted([(1, 1_000_000, 1, "fix"), (1, 1_030_000, 1, "lost"), (1, 1_205_000, 6, "fix"), (1, 1_235_000, 6, "lost")], key=repr)
    assert [r for r in found if r[0] == 2] == sorted([(2, 1_010_000, 3, "fix"), (2, 1_040_000, 3, "lost"), (2, 1_200_000, 4, "fix"), (2, 1_230_000, 4, "lost")], key=repr)


def test_progress_needs_no_order_and_counts_repeats_once(rocks):
    chunks = derived(rocks, SF, "chunks")
    parts = [chunks.filter((F.col("chunk") * 5 + F.col("load_id")) % 3 == n) for n in range(3)]
    found = streamed(rocks, [*parts, parts[0]], live.progress_stream, "progress")
    assert found == rows(live.progress(chunks.unionByName(parts[1]))) and len(found) == chunks.count()
    assert rows(live.progress(chunks.filter("chunk <> 1")).filter("chunk > 0")) == []
