"""All registered queries of the workflow-state engine, with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from floeline.functions.cron import fire
from floeline.functions.scalars import backoff_ns, labels_match
from floeline.operators import graph, lookups
from floeline.operators import transitions as tr
from floeline.operators.claims import candidates
from floeline.operators.waits import resolutions
from floeline.plans.state_queries import EVENT_AT, QUERIES, SLOTS, text_for
from floeline.sources.shared import numbered, settled
from floeline.sources.state import NOW, dealt_steps, duck_sql, run_sql, table
from floeline.streaming.events import bound_runs, drained, emitted_stream


class State:
    """The derived tables of a folder, each read when it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def _claimable(s: State) -> DataFrame:
    found = candidates(s.steps, s.runs, s.step_keys, s.queue_pauses, NOW, ["gpu"]).filter(F.col("rn") <= SLOTS)
    return found.select("id", "queue", "status", "priority", "run_at", "ord", "concurrency_key", "key_limit", "running", "rn")


def _admitted(s: State) -> DataFrame:
    """Single keys, queues by themselves: as many of a key as it has room for, in order."""
    place = F.row_number().over(Window.partitionBy("queue", "concurrency_key").orderBy("rn"))
    found = _claimable(s).withColumn("k", place).filter("concurrency_key = '' OR key_limit <= 0 OR running + k <= key_limit")
    return found.select("id", "queue", "rn")


def _routing(s: State) -> DataFrame:
    counts = lambda labels: s.steps.filter(labels_match("labels", labels)).groupBy("labels", "status").agg(F.count("*").alias("n"))
    return counts(["gpu"]).union(counts(["linux", "gpu"]).withColumn("labels", F.concat("labels", F.lit(" on both"))))


def _cancelled(s: State) -> DataFrame:
    _, steps, signals = tr.cancelled(s.runs, s.steps, s.runs.filter("workflow = 'wf_4'").select("id"), NOW)
    return steps.select("id", F.col("status").alias("action")).union(signals.select("id", F.lit("SIGNAL").alias("action")))


def _paused(s: State) -> DataFrame:
    runs, steps = tr.paused(s.runs, s.steps, s.runs.filter("workflow = 'wf_5'").select("id"), NOW)
    counts = steps.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("requeued"))
    return runs.select("id").join(counts, "id", "left").select("id", F.coalesce("requeued", F.lit(0)).cast("long").alias("requeued"))


def _purged(s: State) -> DataFrame:
    gone = tr.of_runs(s.steps, tr.purgeable(s.runs, s.steps, NOW))
    return gone.groupBy("run_id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("steps"), F.count("*").alias("runs"))


def _groups(s: State) -> DataFrame:
    steps, tasks = dealt_steps(s.spark, s.sf_dir)
    late = F.col("ord") >= 2
    after = F.when(late, F.array(F.lit("early"))).otherwise(F.array().cast("array<string>"))
    groups = steps.select("run_id", F.col("name").alias("step"), F.when(late, "late").otherwise("early").alias("grp"), after.alias("after"))
    return tr.group_members(groups, groups, tasks)


#: What the operators give with the parameters of the oracles' texts.
OPERATORS = {
    "runs_by_status": lambda s: lookups.runs_by_status(s.runs),
    "queue_depth": lambda s: lookups.queue_depth(s.steps),
    "rate_remaining": lambda s: lookups.rate_remaining(s.steps, 2400, 2_592_000_000_000_000, NOW),
    "next_due": lambda s: lookups.next_due(s.steps),
    "run_outcome": lambda s: lookups.run_outcome(s.steps, "qty"),
    "group_status": lambda s: lookups.group_status(s.steps),
    "get_run": lambda s: lookups.get_run(s.runs, "r42").select("id", "workflow", "kind", "status", "queue", "priority", "created_at"),
    "get_steps": lambda s: lookups.get_steps(s.steps, "r42").select("id", "name", "ord", "status", "depends_on"),
    "dep_outputs": lambda s: lookups.dep_outputs(s.steps, ["s0", "s1"], "qty"),
    "list_runs_page": lambda s: lookups.list_runs(s.runs, status="RUNNING", workflow="wf_3", offset=20).select("id", "workflow", "status", "created_at"),
    "dead_letters": lambda s: lookups.dead_letters(s.runs).select("id", "workflow", "dead_lettered_at"),
    "run_children": lambda s: lookups.children(s.runs).select("parent_id", "id", "created_at", "pos"),
    "event_page": lambda s: lookups.event_page(s.emitted).select("seq", "name", "payload"),
    "log_tail": lambda s: lookups.log_tail(s.logs).select("seq", "run_id", "level", "message"),
    "orphan_logs": lambda s: lookups.orphan_logs(s.logs, s.runs).select("seq", "run_id"),
    "claim_candidates": _claimable,
    "claim_admitted": _admitted,
    "label_routing": _routing,
    "seq_allocation": lambda s: numbered(s.runs.filter("status = 'QUEUED' AND custkey % 5 = 0").select("id", "created_at"), "created_at", "id").select("id", (F.lit(1000) + F.col("place")).alias("allotted")),
    "ready_steps": lambda s: tr.ready(settled(s.steps), NOW).select("id"),
    "final_fail_cancels": lambda s: tr.finally_failed(s.runs, s.steps, s.steps.filter("status = 'RUNNING' AND attempts >= max_attempts").select("id", "error"), NOW)[1].select("id", "status"),
    "cancel_run": _cancelled,
    "pause_runs": _paused,
    "resume_runs": lambda s: tr.resumed(s.runs, s.steps, s.runs.select("id"), NOW)[1].select("id", "run_at"),
    "snooze_runs": lambda s: tr.snoozed(s.runs, s.steps, s.runs.select("id"), NOW)[0].select("id"),
    "park_steps": lambda s: tr.parked(s.steps, NOW).select("id", "attempts", "claimed_at", "run_at", "status"),
    "dead_letter_retry": lambda s: tr.revived(s.runs, s.steps, s.runs.select("id"), NOW)[1].select("id", "status", "attempts"),
    "purge_selection": lambda s: tr.purgeable(s.runs, s.steps, NOW).select("id", "completed_at"),
    "purge_counts": _purged,
    "expired_leases": lambda s: tr.reaped(s.steps, s.runs, NOW, 0).select("id", "status", "worker_id", "run_at", "attempts"),
    "lease_heartbeat": lambda s: tr.beaten(s.steps, "w1", NOW + 30_000_000_000).select("id", "lease_expires_at"),
    "interrupt_sweep": lambda s: tr.interrupted(s.runs, s.steps, "w2")[0].select("id", "status"),
    "recover_requeue": lambda s: tr.recovered(s.runs, s.steps, True, NOW)[1].select("id", "status"),
    "recover_fail": lambda s: tr.recovered(s.runs, s.steps, False, NOW)[0].select("id", "status"),
    "deliver_event": lambda s: tr.delivered(s.waits, s.steps, s.runs, "click", "{}", EVENT_AT)[0].select("step_id"),
    "wait_resolution": lambda s: resolutions(s.waits, s.emitted),
    "backoff_schedule": lambda s: s.steps.filter("status = 'RUNNING'").select("id", "attempts", backoff_ns("attempts").alias("delay")),
    "dag_edges": lambda s: graph.step_edges(s.steps),
    "group_expansion": _groups,
    "run_tree": lambda s: graph.run_tree(s.runs),
    "dag_levels": lambda s: graph.levels(s.steps),
    **{f"key_strategy_victims_{k}": lambda s, k=k: tr.victims(s.runs, "custkey", 2, k).select("id", "custkey") for k in ("newest", "in_progress", "except_newest", "except_oldest")},
}


def cron_fire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schedules due at the fixed clock, with their next times."""
    return fire(spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr(*CRONS), NOW)


def stream_event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that the subscriptions start, from the events read as a stream."""
    runs = bound_runs(emitted_stream(spark, f"{sf_dir}/events.parquet"), table(spark, sf_dir, "subscriptions"))
    return drained(runs, "event-runs").select("run_id", "task", "seq")


#: Schedules derived from the nations, around the fixed clock.
CRONS = [
    "CONCAT('c', CAST(n_nationkey AS STRING)) AS name",
    "CASE n_nationkey % 4 WHEN 0 THEN '@every 90m' WHEN 1 THEN '@hourly' WHEN 2 THEN '30 6 * * *' ELSE '@weekly' END AS spec",
    f"CAST({NOW} + (n_nationkey - 12) * 3600000000000 AS BIGINT) AS next_at",
]
HOUR, DAY = 3_600_000_000_000, 86_400_000_000_000
#: The next times of these four kinds by arithmetic; 1970-01-04 was a Sunday.
CRON_FIRE = f"""
SELECT CONCAT('c', CAST(n_nationkey AS VARCHAR)) AS name, CAST({NOW} + (n_nationkey - 12) * {HOUR} AS BIGINT) AS occurrence,
 CAST(CASE n_nationkey % 4 WHEN 0 THEN {NOW} + {HOUR} * 3 // 2 WHEN 1 THEN ({NOW} // {HOUR} + 1) * {HOUR}
  WHEN 2 THEN (({NOW} - {HOUR} * 13 // 2) // {DAY} + 1) * {DAY} + {HOUR} * 13 // 2 ELSE (({NOW} - 3 * {DAY}) // (7 * {DAY}) + 1) * 7 * {DAY} + 3 * {DAY} END AS BIGINT) AS next_at
FROM nation WHERE n_nationkey <= 12
"""
DAG_LEVELS = """
WITH RECURSIVE e AS (EDGES), t(run_id, name, level) AS (SELECT run_id, name, 0 FROM steps WHERE depends_on = '' UNION SELECT e.run_id, e.dst, t.level + 1 FROM t JOIN e ON e.run_id = t.run_id AND e.src = t.name)
SELECT run_id, name, CAST(MAX(level) AS BIGINT) AS level FROM t GROUP BY run_id, name
"""


def queries() -> dict:
    def bound(name: str):
        if name in OPERATORS:
            return lambda spark, sf_dir: OPERATORS[name](State(spark, sf_dir))
        return lambda spark, sf_dir: run_sql(spark, sf_dir, text_for(name, "spark"))

    return {name: bound(name) for name in {**QUERIES, **OPERATORS}} | {"cron_fire": cron_fire, "stream_event_runs": stream_event_runs}


def oracle_sql() -> dict:
    found = {name: duck_sql(text_for(name, "duck")) for name in QUERIES}
    edges = duck_sql(text_for("dag_edges", "duck"))
    head, _, tail = edges.rpartition("SELECT s.run_id, x.dep")
    found["dag_levels"] = head.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + ", " + DAG_LEVELS.replace("EDGES", "SELECT s.run_id, x.dep" + tail).replace("WITH RECURSIVE ", "", 1)
    found["run_tree"] = duck_sql(QUERIES["run_tree"]).replace("WITH runs", "WITH RECURSIVE runs", 1).replace(" WITH RECURSIVE t(", ", t(", 1)
    found["cron_fire"] = CRON_FIRE
    found["stream_event_runs"] = duck_sql("SELECT CONCAT(s.task, '/', CAST(e.seq AS VARCHAR)) AS run_id, s.task, e.seq FROM {emitted} e JOIN {subscriptions} s ON s.event = e.name")
    return found
