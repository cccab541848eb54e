"""Events as streams: bindings start runs, transitions are followed, waits are resolved.

Each query reads its source incrementally and keeps its progress in a checkpoint
folder of the shared storage, so a restart neither loses nor repeats a batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floeline.sources.shared import shared_dir

#: Subscriptions up to which the static side is broadcast; beyond, a shuffle join.
BROADCAST_ROWS = 100_000


def emitted_stream(spark: SparkSession, path: str) -> DataFrame:
    """(seq, name, payload, at) of an event table that grows by files."""
    schema = spark.read.parquet(path).schema
    # As a pattern, the path may be a folder or a single file.
    raw = spark.readStream.schema(schema).parquet(path + "*")
    return raw.select(F.col("event_id").alias("seq"), F.col("event_type").alias("name"), F.col("props").alias("payload"), F.col("ts").cast("timestamp").alias("at"))


def bound_runs(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(run_id, task, seq, payload): one run for each event and task bound to it; its id follows from both."""
    side = subscriptions.select(F.col("event").alias("name"), "task").distinct()
    if side.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    return events.join(side, "name").select(F.concat_ws("/", "task", F.col("seq").cast("string")).alias("run_id"), "task", "seq", "payload")


def followed(transitions: DataFrame, run_id: str | None = None) -> DataFrame:
    """The transitions of one run, or of all; none is dropped."""
    return transitions if run_id is None else transitions.filter(F.col("run_id") == run_id)


def counts_by_window(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(name, start, n): events by tumbling window; state is kept until the watermark passes."""
    counted = events.withWatermark("at", late).groupBy("name", F.window("at", width).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("name", F.col("w.start").alias("start"), "n")


def resolved_waits(events: DataFrame, waits: DataFrame, late: str = "1 day") -> DataFrame:
    """(step_id, name, at, payload): events that came after a wait was registered and before its deadline.

    Waits: step_id, name, registered, deadline (timestamps). Stream against stream, bounded by the
    deadline: an event is kept no longer than the watermark needs it.
    """
    left = waits.withWatermark("registered", late).withColumnRenamed("name", "wait_name")
    right = events.withWatermark("at", late)
    met = (F.col("wait_name") == F.col("name")) & (F.col("at") >= F.col("registered")) & (F.col("at") < F.col("deadline"))
    # The bound on event time that lets state go; deadlines are at most a week off.
    met &= F.col("at") <= F.col("registered") + F.expr("INTERVAL 7 DAYS")
    return left.join(right, met).select("step_id", "name", "at", "payload")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there now, and reads back what it wrote."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")
