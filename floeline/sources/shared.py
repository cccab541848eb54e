"""Rows that are computed once and kept where every executor can read them."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; in local mode a folder is set where there is none (tests), on a cluster that is an error."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="floeline-"))
    return context._jsc.sc().getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """The rows with gapless numbers from 1 in the given order, sorted in ranges; one count of each range goes to the driver."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    ranged = settled(ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at") % F.lit(1 << 33)))
    before, total = [], 0
    for r in ranged.groupBy("_part").count().orderBy("_part").collect():
        before.append((r["_part"], total))
        total += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "_part long, _offset long")
    return ranged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_offset") + F.col("_at") + 1).drop("_part", "_at", "_offset")
