"""Claiming steps: gates as joins, an order per queue, and admission of the few that fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from floeline.functions.scalars import labels_match
from floeline.operators.lookups import active, due
from floeline.sources.shared import settled

#: Slots of a queue that was not configured, and the window of a rate without one: fixed values.
SLOTS, WINDOW = 10, 1_000_000_000
#: Rows up to which a gate's counted table is broadcast.
BROADCAST_ROWS = 500_000


@dataclass
class Budget:
    """Of one queue: steps at a time, and starts within a window (rate 0: no bound)."""

    slots: int = SLOTS
    rate: int = 0
    window_ns: int = WINDOW


def _small(df: DataFrame) -> DataFrame:
    df = settled(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _labelled(steps: DataFrame, offered: list[str]):
    """Whether the step's labels, an array or comma separated, are all among the worker's."""
    if dict(steps.dtypes)["labels"] == "string":
        return labels_match("labels", offered)
    return F.size(F.array_except("labels", F.array(*[F.lit(x) for x in offered]).cast("array<string>"))) <= 0


def candidates(steps: DataFrame, runs: DataFrame, keys: DataFrame, pauses: DataFrame, now: int, labels: list[str]) -> DataFrame:
    """Steps that are due and pass every gate, with the RUNNING steps of their key and their place ``rn`` in their queue.

    Gates: concurrency key, sequence, named keys, paused queue, paused run, labels. Only active steps matter to any of them,
    so these are read once; each gate is an aggregate of them, broadcast if its rows are few.
    """
    steps = settled(steps.filter(active()))
    running = _small(steps.filter("status = 'RUNNING' AND concurrency_key != ''").groupBy("concurrency_key").agg(F.count("*").alias("running")))
    heads = _small(steps.filter("sequence_key != ''").groupBy("sequence_key").agg(F.min("seq").alias("head")))
    found = steps.filter(due(now)).filter(_labelled(steps, labels))
    found = found.join(F.broadcast(pauses.select("queue")), "queue", "left_anti")
    found = found.join(_small(runs.filter("status = 'PAUSED'").select(F.col("id").alias("run_id"))), "run_id", "left_anti")
    found = found.join(running, "concurrency_key", "left").withColumn("running", F.coalesce("running", F.lit(0).cast("long")))
    found = found.filter("concurrency_key = '' OR key_limit <= 0 OR running < key_limit")
    found = found.join(heads, "sequence_key", "left").filter("sequence_key = '' OR seq <= head")
    # Named keys: of those that some RUNNING step holds, a step may hold none that is full by its own limit.
    held = _small(keys.join(_small(steps.filter("status = 'RUNNING'").select(F.col("id").alias("step_id"))), "step_id").groupBy("name", "value").agg(F.count("*").alias("held")))
    full = _small(keys.filter("key_limit > 0").join(held, ["name", "value"]).filter("held >= key_limit").select(F.col("step_id").alias("id")).distinct())
    found = found.join(full, "id", "left_anti")
    order = Window.partitionBy("queue").orderBy(F.desc("priority"), "run_at", "ord", "id")
    return found.withColumn("rn", F.row_number().over(order).cast("long"))


def claim(steps: DataFrame, runs: DataFrame, keys: DataFrame, pauses: DataFrame, now: int, labels: list[str], budgets: dict[str, Budget] | None = None, queues: list[str] | None = None) -> list[dict]:
    """The ids of the steps to start, in order: [{id, run_id, queue, status}].

    Queues are taken by name. Each has its slots less its RUNNING steps, and no more than its rate leaves. Its
    first candidates are then admitted one by one against what was admitted before, for the concurrency key and all
    named keys, over all queues; who is refused is not replaced from beyond the slots. At most the sum of all
    slots of rows comes to the driver.
    """
    budgets = budgets or {}
    steps = settled(steps)
    found = settled(candidates(steps, runs, keys, pauses, now, labels))
    known = [r["queue"] for r in found.select("queue").distinct().collect()] if queues is None else queues
    load = {r["queue"]: r for r in steps.groupBy("queue").agg(F.count(F.when(F.col("status") == "RUNNING", 1)).alias("running")).collect()}
    left: dict[str, int] = {}
    for queue in sorted(known):
        budget = budgets.get(queue, Budget())
        left[queue] = budget.slots - (load[queue]["running"] if queue in load else 0)
        if budget.rate > 0:
            since = now - (budget.window_ns if budget.window_ns > 0 else WINDOW)
            left[queue] = min(left[queue], budget.rate - steps.filter((F.col("queue") == queue) & (F.col("claimed_at") >= since)).count())
    left = {q: n for q, n in left.items() if n > 0}
    if not left:
        return []
    few = settled(found.join(F.broadcast(steps.sparkSession.createDataFrame(list(left.items()), "queue string, slots long")), "queue").filter("rn <= slots"))
    own = F.broadcast(few.select(F.col("id").alias("step_id")))
    named: dict[str, list] = {}
    for r in keys.filter("key_limit > 0").join(own, "step_id").collect():
        named.setdefault(r["step_id"], []).append((r["name"], r["value"], r["key_limit"]))
    wanted = F.broadcast(keys.join(own, "step_id").select("name", "value").distinct())
    running = steps.filter("status = 'RUNNING'").select(F.col("id").alias("step_id"))
    held = {(r["name"], r["value"]): r["n"] for r in keys.join(wanted, ["name", "value"], "left_semi").join(running, "step_id", "left_semi").groupBy("name", "value").agg(F.count("*").alias("n")).collect()}
    every: dict[str, list] = {}
    # A step counts for each of its named keys, also those without a limit of its own.
    for r in keys.join(own, "step_id").collect():
        every.setdefault(r["step_id"], []).append((r["name"], r["value"]))
    one: dict[str, int] = {}
    out = []
    for r in few.select("id", "run_id", "queue", "status", "concurrency_key", "key_limit", "running", "rn").orderBy("queue", "rn").collect():
        key = r["concurrency_key"]
        if key and r["key_limit"] > 0 and r["running"] + one.get(key, 0) >= r["key_limit"]:
            continue
        if any(held.get((n, v), 0) >= most for n, v, most in named.get(r["id"], [])):
            continue
        if key:
            one[key] = one.get(key, 0) + 1
        for pair in every.get(r["id"], []):
            held[pair] = held.get(pair, 0) + 1
        out.append({"id": r["id"], "run_id": r["run_id"], "queue": r["queue"], "status": r["status"]})
    return out


def started(steps: DataFrame, runs: DataFrame, ids: DataFrame, worker: str, now: int, lease_ns: int = 30_000_000_000) -> tuple[DataFrame, DataFrame]:
    """(runs, steps) after the claim of ``ids``: a QUEUED step spends a try, a SUSPENDED one goes on; QUEUED runs are RUNNING."""
    hit = steps.join(ids.select("id"), "id", "left_semi").select(*steps.columns)
    fresh, long = F.col("status") == "QUEUED", lambda n: F.lit(n).cast("long")
    after = hit.withColumns({
        "attempts": F.col("attempts") + F.when(fresh, 1).otherwise(0),
        "started_at": F.when(fresh & (F.col("started_at") == 0), long(now)).otherwise(F.col("started_at")),
        "claimed_at": long(now), "worker_id": F.lit(worker), "lease_expires_at": long(now + lease_ns),
        "resume_at": long(0), "wait_kind": F.lit(""), "wait_event": F.lit(""), "status": F.lit("RUNNING"),
    })
    own = runs.filter("status = 'QUEUED'").join(hit.select(F.col("run_id").alias("id")).distinct(), "id", "left_semi").select(*runs.columns)
    first = F.when(F.col("started_at") == 0, long(now)).otherwise(F.col("started_at"))
    return own.withColumns({"status": F.lit("RUNNING"), "attempts": F.col("attempts") + 1, "started_at": first}), after
