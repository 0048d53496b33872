"""Request streams: debounce and latest-wins, as batch and as stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """``(user_id, session, n, last_event)``: a user's events that follow within the gap."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    new = F.when(micros - F.lag(micros).over(order) <= gap_seconds * 1_000_000, 0).otherwise(1)
    marked = events.withColumn("new", new).withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id"))["event_id"].alias("last_event"))


def latest(events: DataFrame) -> DataFrame:
    """``(user_id, event_id, event_type)``: every user's newest request; also for a stream in
    complete mode."""
    best = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("b"))
    return best.select("user_id", "b.event_id", "b.event_type")


def answered(requests: DataFrame) -> DataFrame:
    """``requests(event_id, user_id, ts, answered)`` -> those with ``shown``: whether an answer came while its request was still the
    user's newest. A later request, even in the same instant, makes it stale."""
    later = F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return requests.withColumn("shown", later.isNull() | (F.col("answered") < later)).select("event_id", "user_id", "shown")


def latest_stream(spark: SparkSession, sf_dir: str, checkpoint: str, name: str = "latest_requests"):
    """The same over a file stream: a started query that keeps the newest request of each user."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return latest(stream).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
