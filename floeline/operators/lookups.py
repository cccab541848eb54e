"""Read operators over state tables, with parameters; each returns a DataFrame. Limits here are the operators' own (pages)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floeline.sources.tables import ACTIVE, TERMINAL

#: Default and largest page of runs, default pages of events, dead letters and logs, most steps of a run: fixed values.
PAGE, MOST_PAGE, EVENTS, LOGS, STEPS = 100, 1000, 100, 500, 10_000


def count_if(condition: Column, name: str) -> Column:
    return F.count(F.when(condition, 1)).alias(name)


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Equality on the columns whose value is given; None and '' mean any."""
    for name, value in wanted.items():
        if value not in (None, ""):
            df = df.filter(F.col(name) == value)
    return df


def due(now: int) -> Column:
    """QUEUED whose time has come, or SUSPENDED with a resume time that has."""
    queued = (F.col("status") == "QUEUED") & (F.col("run_at") <= now)
    return queued | ((F.col("status") == "SUSPENDED") & F.col("resume_at").between(1, now))


def terminal(status: Column | str = "status") -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*TERMINAL)


def active(status: Column | str = "status") -> Column:
    return (F.col(status) if isinstance(status, str) else status).isin(*ACTIVE)


def as_time(ns: Column | str) -> Column:
    """A timestamp of unix nanoseconds (cut to microseconds), null where unset."""
    c = F.col(ns) if isinstance(ns, str) else ns
    return F.when(c > 0, F.timestamp_micros(F.floor(c / 1000).cast("long")))


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.filter(F.col("id") == run_id)


def get_steps(steps: DataFrame, run_id: str) -> DataFrame:
    return steps.filter(F.col("run_id") == run_id).orderBy("ord").limit(STEPS)


def dep_outputs(steps: DataFrame, names: list[str], output: str = "output", run_id: str | None = None) -> DataFrame:
    """(run_id, name, output) of the named steps that succeeded."""
    found = matching(steps, run_id=run_id).filter((F.col("status") == "SUCCEEDED") & F.col("name").isin(*names))
    return found.select("run_id", "name", F.col(output).alias("output"))


def list_runs(runs: DataFrame, status=None, queue=None, workflow=None, parent_id=None, limit: int = 0, offset: int = 0) -> DataFrame:
    """A page of runs, newest first."""
    found = matching(runs, status=status, queue=queue, workflow=workflow, parent_id=parent_id)
    return found.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(min(limit or PAGE, MOST_PAGE))


def dead_letters(runs: DataFrame, workflow=None, queue=None, limit: int = 0, offset: int = 0) -> DataFrame:
    found = matching(runs, workflow=workflow, queue=queue).filter("dead_lettered_at > 0")
    return found.orderBy(F.desc("dead_lettered_at"), F.desc("id")).offset(offset).limit(min(limit or PAGE, MOST_PAGE))


def children(runs: DataFrame, parent_id: str | None = None) -> DataFrame:
    """Runs that have a parent, with their place among its children, oldest first."""
    order = Window.partitionBy("parent_id").orderBy("created_at", "id")
    return matching(runs, parent_id=parent_id).filter("parent_id != ''").withColumn("pos", F.row_number().over(order).cast("long"))


def event_page(events: DataFrame, name=None, limit: int = EVENTS) -> DataFrame:
    return matching(events, name=name).orderBy(F.desc("seq")).limit(limit)


def log_tail(logs: DataFrame, run_id=None, limit: int = LOGS) -> DataFrame:
    """The latest lines, oldest first."""
    return matching(logs, run_id=run_id).orderBy(F.desc("seq")).limit(limit).orderBy("seq")


def orphan_logs(logs: DataFrame, runs: DataFrame) -> DataFrame:
    return logs.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_anti")


def runs_by_status(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("n"))


def queue_depth(steps: DataFrame) -> DataFrame:
    counts = [count_if(F.col("status") == s, s.lower()) for s in ACTIVE]
    return steps.filter(active()).groupBy("queue").agg(*counts)


def rate_remaining(steps: DataFrame, limit: int, window_ns: int, now: int) -> DataFrame:
    """How many steps each queue may still start in the window that ends now."""
    window = window_ns if window_ns > 0 else 1_000_000_000
    started = F.count(F.when(F.col("claimed_at") >= now - window, 1))
    return steps.groupBy("queue").agg(F.greatest(F.lit(0).cast("long"), F.lit(limit).cast("long") - started).alias("remaining"))


def next_due(steps: DataFrame) -> DataFrame:
    """The earliest time at which a step may start, 0 for none."""
    at = F.when(F.col("status") == "QUEUED", F.col("run_at")).when((F.col("status") == "SUSPENDED") & (F.col("resume_at") > 0), F.col("resume_at"))
    return steps.agg(F.coalesce(F.min(at), F.lit(0).cast("long")).alias("due"))


def rolled_up(status: Column) -> Column:
    """FAILED before CANCELLED before INTERRUPTED before anything in flight (RUNNING); SUCCEEDED only where all are."""
    order = {"FAILED": 4, "CANCELLED": 3, "INTERRUPTED": 2, "SUCCEEDED": 0}
    rank = F.lit(1)
    for name, place in order.items():
        rank = F.when(status == name, F.lit(place)).otherwise(rank)
    names = F.array(*[F.lit(x) for x in ("SUCCEEDED", "RUNNING", "INTERRUPTED", "CANCELLED", "FAILED")])
    return F.element_at(names, F.max(rank) + 1)


def group_status(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id").agg(rolled_up(F.col("status")).alias("status"))


def run_outcome(steps: DataFrame, output: str = "output") -> DataFrame:
    """Of runs without an active step: FAILED with its first error by order if a step failed, and the last step's output."""
    failed = F.col("status") == "FAILED"
    done = steps.groupBy("run_id").agg(
        F.max(active()).alias("open"),
        F.when(F.max(failed), "FAILED").otherwise("SUCCEEDED").alias("outcome"),
        F.max("ord").alias("last_ord"),
        F.max_by(output, "ord").alias("output"),
        F.min_by("error", F.when(failed, F.col("ord"))).alias("error"),
    )
    return done.filter("NOT open").drop("open")


def execution(tables: dict[str, DataFrame], run_id: str) -> DataFrame:
    """One row: the run, its steps in order, and its children, all of one version; attempts of all steps in ``tries``."""
    steps = tables["steps"].filter(F.col("run_id") == run_id).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("ord", "name", "task", "status", "attempts", "error", "output"))).alias("steps"), F.sum("attempts").alias("tries"))
    kids = tables["runs"].filter(F.col("parent_id") == run_id).groupBy(F.col("parent_id").alias("run_id")).agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "parent_step", "status", "dead_lettered_at", "ephemeral"))).alias("children"))
    run = get_run(tables["runs"], run_id).withColumnRenamed("id", "run_id")
    return run.join(steps, "run_id", "left").join(kids, "run_id", "left")
