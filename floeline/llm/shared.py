"""The shared folder, and small helpers that every operator of this subpackage uses."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows (of a few numbers) up to which a counted table is broadcast; beyond, a shuffle join.
BROADCAST_ROWS = 2_000_000
#: Rows of a few numbers that a task of a small intermediate table should hold at least.
TASK_ROWS = 200_000
#: Numbers (one more for each row) up to which a table is broadcast where an operator makes many: the driver holds each several times over.
BROADCAST_VALUES = 1_500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where a session in local mode has none (tests), a temporary folder is made and set; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if not folder and known.isDefined():
        return known.get()
    if not folder:
        if not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="floeline-")
    if not known.isDefined():
        context.setCheckpointDir(folder)
    return folder


def estimated(df: DataFrame) -> DataFrame:
    """As ``settled``, with Spark's own estimate of the size, which joins of small tables are planned by: always in one way."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows, computed once and kept in the shared folder; later reads survive lost executors.

    ``rows``: a bound of their number, where one is known; a small table then gets few tasks and files.
    The table's size counts as unknown: Spark's own estimate is the product of what was joined, which a checkpoint
    keeps, so that after some rounds of joins it has as many digits as fill the driver's heap.
    """
    shared_dir(df.sparkSession)
    out = (df if rows is None else df.coalesce(1 + rows // TASK_ROWS)).checkpoint(eager=True)
    jvm, session, plan = df.sparkSession._jvm, df.sparkSession._jsparkSession, out._jdf.queryExecution().analyzed()
    none = jvm.scala.Option.empty()
    plan = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, session, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(session, plan), df.sparkSession)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """For the side of a join: broadcast if it has at most ``rows`` rows. It is counted, so it should be settled."""
    return F.broadcast(df) if df.count() <= rows else df


def gathered(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows ``settled``, and their number; later reads take as many tasks as that many rows need."""
    out = settled(df)
    rows = out.count()
    return out.coalesce(1 + rows // TASK_ROWS), rows


def light(df: DataFrame, rows: int | None = None) -> DataFrame:
    """For the side of a join, as ``small``, by the numbers that its rows hold; ``rows``: their number or a bound of it, where known."""
    return F.broadcast(df) if (df.count() if rows is None else rows) * (1 + len(df.columns)) <= BROADCAST_VALUES else df


def fresh(*names: str) -> list[str]:
    """Column names that no table has, so that columns of any name can stand beside them."""
    mark = uuid.uuid4().hex
    return [f"{name}_{mark}" for name in names]


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in a fresh folder of the shared folder.

    Columnar and compressed, so the better choice than ``settled`` for wide rows.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that are written for the course of one operator; ``close`` deletes them all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder, self.tables = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def written(self, df: DataFrame) -> DataFrame:
        """The rows as a Parquet table, better than ``settled`` for wide rows."""
        self.tables += 1
        path = f"{self.folder}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def spending(spark: SparkSession):
    """Tables made and computed inside give up their shuffle files as soon as they are computed, not when the driver finds that
    nothing refers to them, which it may not for the last ones. For what is settled or collected inside, once."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    had = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, had)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the broadcasts, shuffle files and checkpoints that nothing refers to, and the driver shrink its heaps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    # The C library keeps freed memory of the driver's Python otherwise; not every one has the call.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
#: Settings of the C library's and Arrow's allocators in Python workers: large arrays go back to the system when freed.
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": str(2 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it, whatever their working folder,
    and keeps idle workers small."""
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)
    here = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, known]))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def remainder(doc_id: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(of)


def whole(text: Column | str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
