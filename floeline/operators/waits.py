"""Which event ends a wait: the first of its name from its registration on, before its deadline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floeline.sources.shared import settled

#: Width of the time buckets that waits and events of a name are dealt over.
BUCKET = 3_600_000_000_000


def resolutions(waits: DataFrame, events: DataFrame, width: int = BUCKET) -> DataFrame:
    """(step_id, delivered_at, outcome) of waits (step_id, event, registered, deadline; 0: none) and events (name, created_at).

    As of, without pairing waits and events: both are sorted within (name, bucket of time), so that a frequent name is spread;
    a wait whose bucket holds no later event takes the first of the next bucket that has one, from a table of buckets.
    """
    at = events.select("name", F.floor(F.col("created_at") / width).cast("long").alias("b"), F.col("created_at").alias("at"))
    asked = waits.select("step_id", F.col("event").alias("name"), F.floor(F.col("registered") / width).cast("long").alias("b"), "registered", "deadline")
    firsts = at.groupBy("name", "b").agg(F.min("at").alias("first")).unionByName(asked.select("name", "b", F.lit(None).cast("long").alias("first")))
    later = Window.partitionBy("name").orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    # One row for each bucket, however many events it holds.
    ahead = settled(firsts.groupBy("name", "b").agg(F.min("first").alias("first")).select("name", "b", F.min("first").over(later).alias("ahead")))
    every = at.select("name", "b", F.col("at").alias("t"), "at", F.lit(None).cast("string").alias("step_id"), F.lit(None).cast("long").alias("deadline"))
    every = every.unionByName(asked.select("name", "b", F.col("registered").alias("t"), F.lit(None).cast("long").alias("at"), "step_id", "deadline"))
    here = F.min("at").over(Window.partitionBy("name", "b").orderBy("t").rangeBetween(Window.currentRow, Window.unboundedFollowing))
    met = every.withColumn("here", here).filter("step_id IS NOT NULL").join(ahead, ["name", "b"]).withColumn("found", F.coalesce("here", "ahead"))
    in_time = (F.col("deadline") == 0) | (F.col("found") < F.col("deadline"))
    outcome = F.when(F.col("found").isNotNull() & in_time, "DELIVERED").when(F.col("deadline") > 0, "TIMEOUT").otherwise("WAITING")
    return met.select("step_id", F.when(F.col("found").isNotNull() & in_time, F.col("found")).alias("delivered_at"), outcome.alias("outcome"))
