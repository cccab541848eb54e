"""The engine: a store of versioned tables, and every operation on it as one commit over many rows.

Decisions are made by one writer at a time (a commit fails if another came first). Steps' functions run on the
driver and may start Spark jobs of any size; a table that they return is written as Parquet and handed to dependants
as a DataFrame. Starting, finishing and failing steps are set-wise: one commit for all steps of a tick.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floeline.functions.cron import next_fire
from floeline.operators import dag, lookups
from floeline.operators import transitions as tr
from floeline.operators.claims import Budget, claim, started
from floeline.sources.shared import settled
from floeline.sources.store import Store
from floeline.sources.tables import KEYS, SCHEMAS, TERMINAL
from floeline.tasks import (
    Context, DuplicateJob, Json, NonTerminalPurge, NotDeadLetter, NotFound, RunCancelled, RunError, RunInterrupted, RunRunning, RunTerminal, Suspended, Task, UnknownTask, Veto, Workflow,
)

HOOKS = ("before_enqueue", "after_enqueue", "before_step", "after_step", "before_emit", "after_emit", "on_run_finished")


class Handle:
    def __init__(self, engine: Engine, run_id: str):
        self.engine, self.run_id = engine, run_id

    def done(self) -> bool:
        return self.engine.run(self.run_id)["status"] in TERMINAL

    def result(self) -> Any:
        """The output; RunError and its kinds for a run that ended otherwise."""
        row = self.engine.run(self.run_id)
        if row["status"] == "SUCCEEDED":
            return self.engine.decoded(row["output"])
        kinds = {"CANCELLED": RunCancelled, "INTERRUPTED": RunInterrupted, "FAILED": RunError}
        raise kinds.get(row["status"], RunRunning)(row["error"] or row["status"])


class Engine:
    def __init__(self, spark: SparkSession, path: str, worker: str = "w0", labels: tuple[str, ...] = (), lease_ns: int = 30_000_000_000, clock: Callable[[], int] = time.time_ns, codec: Any = None, middleware: tuple = (), plugins: tuple = (), threads: int = 4):
        self.spark, self.store = spark, Store(spark, path)
        self.worker, self.labels, self.lease_ns, self.clock, self.codec = worker, list(labels), lease_ns, clock, codec or Json()
        self.middleware, self.plugins, self.threads = list(middleware), list(plugins), threads
        self.tasks: dict[str, Task | Workflow] = {}
        self.handlers: dict[str, Task] = {}
        self.budgets: dict[str, Budget] = {}

    # What is there

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        return self.store.snapshot(version)

    def run(self, run_id: str) -> dict:
        row = lookups.get_run(self.tables()["runs"], run_id).first()
        if row is None:
            raise NotFound(run_id)
        return row.asDict()

    def steps(self, run_id: str) -> list[dict]:
        return [r.asDict() for r in lookups.get_steps(self.tables()["steps"], run_id).collect()]

    def execution(self, run_id: str) -> DataFrame:
        return lookups.execution(self.tables(), run_id)

    def runs(self, **filters) -> DataFrame:
        return lookups.list_runs(self.tables()["runs"], **filters)

    def dead_letters(self, **filters) -> DataFrame:
        return lookups.dead_letters(self.tables()["runs"], **filters)

    def events(self, **filters) -> DataFrame:
        return lookups.event_page(self.tables()["events"], **filters)

    def logs(self, **filters) -> DataFrame:
        return lookups.log_tail(self.tables()["logs"], **filters)

    def crons(self) -> DataFrame:
        return self.tables()["crons"].orderBy("name")

    def subscriptions(self) -> DataFrame:
        return self.tables()["subscriptions"].orderBy("event", "task")

    def paused_queues(self) -> list[str]:
        return [r["queue"] for r in self.tables()["queue_pauses"].orderBy("queue").collect()]

    def metrics(self) -> dict:
        """{runs: {status: n}, queues: {queue: {status: n}}}; pushed by calling it periodically."""
        t = self.tables()
        return {"runs": {r["status"]: r["n"] for r in lookups.runs_by_status(t["runs"]).collect()}, "queues": {r["queue"]: {k: v for k, v in r.asDict().items() if k != "queue"} for r in lookups.queue_depth(t["steps"]).collect()}}

    def next_due(self) -> int:
        return lookups.next_due(self.tables()["steps"]).first()[0]

    def transitions(self, since: int, run_id: str | None = None) -> DataFrame:
        """(run_id, step, status) of runs and steps that differ from version ``since``; step is '' for a run. None is lost."""
        rows = lambda t: t["runs"].select(F.col("id").alias("run_id"), F.lit("").alias("step"), "status").union(t["steps"].select("run_id", F.col("name").alias("step"), "status"))
        return lookups.matching(rows(self.tables()).exceptAll(rows(self.tables(since))), run_id=run_id)

    def output(self, run_id: str, name: str) -> Any:
        row = lookups.dep_outputs(self.tables()["steps"], [name], run_id=run_id).first()
        if row is None:
            raise NotFound(f"{run_id}/{name}")
        return self.decoded(row["output"])

    def decoded(self, text: str | None) -> Any:
        value = self.codec.loads(text)
        return self.spark.read.parquet(value["parquet"]) if isinstance(value, dict) and set(value) == {"parquet"} else value

    def graph(self, run_id: str) -> dag.Graph:
        """The run's steps with their states; groups as they were declared."""
        groups = [dag.Group(**g) for g in self.codec.loads(self.run(run_id)["groups_json"] or "[]")]
        of = {s: g.name for g in groups for s in g.steps}
        return dag.snapshot([dag.Node(s["name"], s["depends_on"], s["status"], of.get(s["name"], ""), s["task"], s["attempts"], s["error"]) for s in self.steps(run_id)], groups)

    def tree(self, run_id: str) -> dag.Graph:
        """The run and the runs that it started, from one version."""
        t = self.tables()
        nodes = lambda rid: [dag.Node(s["name"], s["depends_on"], s["status"], "", s["task"], s["attempts"], s["error"]) for s in lookups.get_steps(t["steps"], rid).collect()]
        kids = lambda rid, most: [(r["id"], r["parent_step"], r["status"]) for r in lookups.children(t["runs"], rid).orderBy("pos").limit(most).collect()]
        return dag.tree(run_id, nodes, kids)

    # Definitions

    def register(self, *works: Task | Workflow) -> Engine:
        """The latest definition of a name holds; schedules and bindings of that name work from now on."""
        for work in works:
            self.tasks[work.name] = work
            for _, task in work.steps:
                self.handlers[task.name] = task
        return self

    def set_queue(self, queue: str, slots: int = 10, rate: int = 0, window_ns: int = 0) -> None:
        self.budgets[queue or "default"] = Budget(slots if slots > 0 else 10, rate, window_ns if window_ns > 0 else 1_000_000_000)

    def use(self, *plugins) -> None:
        self.plugins += plugins

    def _hook(self, name: str, *values) -> None:
        """Hooks before something may refuse by an exception; the others, in reverse order, are only told."""
        before = name.startswith("before")
        for plugin in self.plugins if before else reversed(self.plugins):
            hook = getattr(plugin, name, None)
            if hook is None:
                continue
            try:
                hook(*values)
            except Exception as e:
                if before:
                    raise Veto(str(e)) from e

    # Enqueueing

    def _rows(self, table: str, rows: list[dict]) -> DataFrame:
        names = [f.name for f in self.spark.createDataFrame([], SCHEMAS[table]).schema]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], SCHEMAS[table])

    def build(self, work: Task | Workflow, value: Any = None, delay_ns: int = 0, run_at: int = 0, priority: int = 0, unique_key: str | None = None, parent: tuple[str, str] = ("", ""), run_id: str | None = None, seq: int = 0) -> tuple[dict, list[dict], list[dict]]:
        """(run, steps, keys) of a request; keys come from the input once. Steps with dependencies are BLOCKED."""
        now = self.clock()
        at, made = run_at or now + delay_ns, work.steps
        run_id = run_id or f"{now:x}-{uuid.uuid4().hex[:12]}"
        first = made[0][1]
        unique = unique_key or (work.unique(value) if isinstance(work, Task) and work.unique else None)
        sequence = first.sequence(value) if first.sequence else ""
        key = first.key(value) if first.key else ""
        text = self.codec.dumps(value)
        groups = [{"name": g.name, "steps": g.steps, "after": g.after} for g in work.groups]
        run = {"id": run_id, "workflow": work.name, "kind": "task" if isinstance(work, Task) else "workflow", "status": "QUEUED", "queue": first.queue, "priority": priority, "input": text, "error": "", "attempts": 0, "max_attempts": 1 + first.retries, "run_at": at, "created_at": now, "started_at": 0, "completed_at": 0, "concurrency_key": key, "parent_id": parent[0], "parent_step": parent[1], "trace_parent": "", "unique_key": unique, "paused_at": 0, "dead_lettered_at": 0, "sequence_key": sequence, "seq": seq, "ephemeral": int(work.ephemeral), "groups_json": self.codec.dumps(groups)}
        steps, keys = [], []
        for k, (node, task) in enumerate(made):
            sid = f"{run_id}/{node.name}"
            steps.append({"id": sid, "run_id": run_id, "name": node.name, "task": task.name, "ord": k, "status": "BLOCKED" if node.deps else "QUEUED", "depends_on": node.deps, "queue": task.queue, "priority": priority, "input": text, "error": "", "attempts": 0, "max_attempts": 1 + task.retries, "timeout_ns": task.timeout_ns, "run_at": at, "created_at": now, "started_at": 0, "completed_at": 0, "concurrency_key": task.key(value) if task.key else "", "key_limit": max(1, task.key_limit) if task.key else 0, "claimed_at": 0, "resume_at": 0, "wait_kind": "", "wait_event": "", "labels": list(task.labels), "worker_id": "", "lease_expires_at": 0, "sequence_key": sequence, "seq": seq})
            keys += [{"step_id": sid, "name": name, "value": fn(value), "key_limit": most} for name, (fn, most) in task.keys.items()]
        return run, steps, keys

    def stage(self, requests: list[tuple]) -> tuple[int, dict[str, DataFrame], dict[str, DataFrame], list[str]]:
        """(base version, changed rows, gone keys, run ids) of requests (work, value, options), all or none; ``commit`` makes them so."""
        base = self.store.version()
        t = self.tables(base)
        for work, value, options in requests:
            if isinstance(work, str) and work not in self.tasks:
                raise UnknownTask(work)
        requests = [(self.tasks[w] if isinstance(w, str) else w, v, o) for w, v, o in requests]
        for work, value, options in requests:
            self._hook("before_enqueue", work, value)
            self.register(work)
        counter = t["counters"].filter("name = 'seq'").first()
        seq = counter["next"] if counter else 1
        built = []
        for work, value, options in requests:
            built.append(self.build(work, value, seq=seq, **options))
            seq += 1
        policies = {(w.unique_conflict if isinstance(w, Task) else "reuse") for (w, _, _), (r, _, _) in zip(requests, built, strict=True) if r["unique_key"]}
        ids, drop, hit = [r["id"] for r, _, _ in built], set(), set()
        for policy in policies:
            mine = [r for (w, _, _), (r, _, _) in zip(requests, built, strict=True) if r["unique_key"] and (w.unique_conflict if isinstance(w, Task) else "reuse") == policy]
            for r in tr.resolved_unique(self._rows("runs", mine), t["runs"], policy).select("id", "action", "owner", "workflow", "unique_key").collect():
                if r["action"] == "ERROR":
                    raise DuplicateJob(r["unique_key"])
                if r["action"] in ("REUSE", "CANCELLED"):
                    drop.add(r["id"])
                    ids = [r["owner"] if i == r["id"] else i for i in ids]
                elif policy == "replace":
                    hit.add((r["workflow"], r["unique_key"]))
        built = [b for b in built if b[0]["id"] not in drop]
        runs, steps = self._rows("runs", [b[0] for b in built]), self._rows("steps", [s for b in built for s in b[1]])
        changed = {"runs": runs, "steps": steps, "step_keys": self._rows("step_keys", [k for b in built for k in b[2]]), "counters": self._rows("counters", [{"name": "seq", "next": seq}])}
        gone = {}
        if hit:
            old = self.spark.createDataFrame(sorted(hit), "workflow string, unique_key string")
            ids_ = tr.live(t["runs"]).join(old, ["workflow", "unique_key"], "left_semi").select("id")
            over, waiting, _ = tr.cancelled(t["runs"], t["steps"], ids_, self.clock())
            changed["runs"], changed["steps"] = changed["runs"].unionByName(over), changed["steps"].unionByName(waiting)
        strategies = {(w.key_strategy, w.key_limit) for w, _, _ in requests if isinstance(w, Task) and w.key_strategy}
        for strategy, limit in sorted(strategies):
            keys = [(r["concurrency_key"],) for (w, _, _), (r, _, _) in zip(requests, built, strict=False) if isinstance(w, Task) and w.key_strategy == strategy]
            after_runs, after_steps = settled(merged(t["runs"], changed["runs"], "runs")), settled(merged(t["steps"], changed["steps"], "steps"))
            mine = after_runs.join(self.spark.createDataFrame(keys, "concurrency_key string").distinct(), "concurrency_key", "left_semi").select(*after_runs.columns)
            picked = tr.victims(mine, "concurrency_key", max(1, limit), strategy).select("id")
            over, waiting, _ = tr.cancelled(after_runs, after_steps, settled(picked), self.clock())
            changed["runs"], changed["steps"] = merged(changed["runs"], settled(over), "runs"), merged(changed["steps"], settled(waiting), "steps")
        return base, changed, gone, ids

    def commit(self, staged: tuple) -> list[Handle]:
        base, changed, gone, ids = staged
        self.store.commit(changed, gone, base)
        for i in ids:
            self._hook("after_enqueue", i)
        return [Handle(self, i) for i in ids]

    def enqueue_batch(self, requests: list[tuple]) -> list[Handle]:
        """Requests (work, value) or (work, value, options), in one commit."""
        return self.commit(self.stage([(r[0], r[1], r[2] if len(r) > 2 else {}) for r in requests]))

    def enqueue(self, work: Task | Workflow | str, value: Any = None, **options) -> Handle:
        return self.enqueue_batch([(work, value, options)])[0]

    # Work

    def tick(self) -> int:
        """Claims what is due, runs it and commits what came of it; the number of steps."""
        base, now = self.store.version(), self.clock()
        t = self.tables(base)
        picked = claim(t["steps"], t["runs"], t["step_keys"], t["queue_pauses"], now, self.labels, self.budgets)
        if not picked:
            return 0
        ids = self.spark.createDataFrame([(p["id"],) for p in picked], "id string")
        runs, steps = started(t["steps"], t["runs"], ids, self.worker, now, self.lease_ns)
        steps = settled(steps)
        self.store.commit({"runs": runs, "steps": steps}, base=base)
        journals: dict[str, dict[int, dict]] = {}
        for r in t["step_journal"].join(ids.withColumnRenamed("id", "step_id"), "step_id", "left_semi").collect():
            journals.setdefault(r["step_id"], {})[r["idx"]] = r.asDict()
        with ThreadPoolExecutor(self.threads) as pool:
            made = list(pool.map(lambda s: self._execute(s, journals.get(s["id"], {}), now), [r.asDict() for r in steps.collect()]))
        self._settle(made)
        return len(made)

    def run_until_idle(self, most: int = 1000) -> None:
        """Ticks until nothing is due."""
        for _ in range(most):
            if not self.tick():
                return

    def _execute(self, step: dict, journal: dict, now: int) -> dict:
        ctx = Context(self, step["run_id"], step["id"], step["name"], step["attempts"], step["depends_on"], journal, now)
        out = {"id": step["id"], "ctx": ctx, "step": step}
        task = self.handlers.get(step["task"])
        try:
            if task is None:
                return out | {"failed": f"unknown task {step['task']}", "final": True}
            try:
                self._hook("before_step", ctx)
            except Veto as e:
                return out | {"failed": str(e), "final": True}
            call = reduce(lambda f, layer: layer(f), reversed([*self.middleware, *task.wrap]), task.fn)
            value = call(ctx, self.codec.loads(step["input"]))
            if isinstance(value, DataFrame):
                path = f"{self.store.path}/outputs/{step['id']}-{uuid.uuid4().hex}"
                value.write.parquet(path)
                value = {"parquet": path}
            return out | {"output": self.codec.dumps(value)}
        except Suspended as s:
            return out | {"wait": s}
        except Exception as e:
            return out | {"failed": f"{type(e).__name__}: {e}"[:4000], "final": task is None or step["attempts"] >= step["max_attempts"]}
        finally:
            self._hook("after_step", ctx)

    def _settle(self, made: list[dict]) -> None:
        """One commit for all outcomes: successes, retries, final failures, suspensions, journals and logs; then readiness and ends."""
        base, now = self.store.version(), self.clock()
        t = self.tables(base)
        frame = lambda rows, schema: self.spark.createDataFrame(rows, schema)
        hit = frame([(m["step"]["run_id"],) for m in made], "id string").distinct()
        # Only the runs that steps ended in are looked at.
        runs = settled(t["runs"].join(F.broadcast(hit), "id", "left_semi").select(*t["runs"].columns))
        steps = settled(tr.of_runs(t["steps"], hit))
        before, old_runs = steps, runs
        steps = merged(steps, tr.succeeded(steps, runs, frame([(m["id"], m["output"]) for m in made if "output" in m], "id string, output string"), now), "steps")
        again: dict[tuple, list] = {}
        for m in made:
            if "failed" in m and not m["final"]:
                b = self.handlers[m["step"]["task"]].backoff
                again.setdefault((b.base_ns, b.factor, b.most_ns), []).append((m["id"], m["failed"]))
        for (b, f, most), rows in again.items():
            steps = merged(steps, tr.retried(steps, frame(rows, "id string, error string"), now, b, f, most), "steps")
        waits = [(m["id"], m["wait"].kind, m["wait"].event, m["wait"].resume_at) for m in made if "wait" in m]
        if waits:
            steps = merged(steps, tr.suspended(steps, frame(waits, "id string, kind string, event string, resume_at long")), "steps")
        steps = settled(steps)
        for dead in (False, True):
            bad = [(m["id"], m["failed"]) for m in made if m.get("final") and bool(getattr(self.tasks.get(next((r["workflow"] for r in old_runs.collect() if r["id"] == m["step"]["run_id"]), "")), "dead_letter", False)) == dead]
            if bad:
                over, ends = tr.finally_failed(runs, steps, frame(bad, "id string, error string"), now, dead)
                runs, steps = settled(merged(runs, over, "runs")), settled(merged(steps, ends, "steps"))
        steps = settled(merged(steps, tr.ready(steps, now), "steps"))
        runs = settled(merged(runs, tr.ended_runs(runs, steps, now), "runs"))
        changed = {"steps": steps.exceptAll(before), "runs": runs.exceptAll(old_runs)}
        gone = {}
        brief = [r["id"] for r in runs.filter(tr.terminal() & (F.col("ephemeral") > 0)).collect()]
        if brief:
            gone = self._gone(t, frame([(i,) for i in brief], "id string"), False)
            changed = {k: v.join(gone[k].select("id"), "id", "left_anti").select(*v.columns) for k, v in changed.items()}
        if entries := [e for m in made for e in m["ctx"].written.values()]:
            changed["step_journal"] = self._rows("step_journal", entries)
        if lines := [(m, k, line) for m in made for k, line in enumerate(m["ctx"].lines)]:
            row = t["counters"].filter("name = 'logs'").first()
            first = row["next"] if row else 1
            changed["logs"] = self._rows("logs", [{"seq": first + n, "run_id": m["step"]["run_id"], "step": m["step"]["name"], "at": now, "level": level, "message": message} for n, (m, _, (level, message)) in enumerate(lines)])
            changed["counters"] = self._rows("counters", [{"name": "logs", "next": first + len(lines)}])
        self.store.commit(changed, gone, base)
        for r in runs.filter(tr.terminal()).collect():
            self._hook("on_run_finished", r["id"], r["status"])

    # Control

    def _ids(self, *run_ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in run_ids], "id string")

    def _guarded(self, run_id: str) -> tuple[int, dict[str, DataFrame]]:
        base = self.store.version()
        t = self.tables(base)
        row = lookups.get_run(t["runs"], run_id).first()
        if row is None:
            raise NotFound(run_id)
        if row["status"] in TERMINAL:
            raise RunTerminal(run_id)
        return base, t

    def cancel(self, *run_ids: str) -> list[str]:
        """Ended runs stay as they are; the ids of RUNNING steps, which end by themselves, are returned."""
        base = self.store.version()
        t = self.tables(base)
        runs, steps, signals = tr.cancelled(t["runs"], t["steps"], self._ids(*run_ids), self.clock())
        self.store.commit({"runs": runs, "steps": steps}, base=base)
        return [r["id"] for r in signals.collect()]

    def pause_run(self, run_id: str) -> None:
        base, t = self._guarded(run_id)
        runs, steps = tr.paused(t["runs"], t["steps"], self._ids(run_id), self.clock())
        self.store.commit({"runs": runs, "steps": steps}, base=base)

    def resume_run(self, run_id: str) -> None:
        base, t = self._guarded(run_id)
        runs, steps = tr.resumed(t["runs"], t["steps"], self._ids(run_id), self.clock())
        self.store.commit({"runs": runs, "steps": steps}, base=base)

    def snooze(self, run_id: str, until: int) -> None:
        base, t = self._guarded(run_id)
        if not t["steps"].filter((F.col("run_id") == run_id) & (F.col("status") == "RUNNING")).isEmpty():
            raise RunRunning(run_id)
        runs, steps = tr.snoozed(t["runs"], t["steps"], self._ids(run_id), until)
        self.store.commit({"runs": runs, "steps": steps}, base=base)

    def pause_queue(self, queue: str) -> None:
        self.store.commit({"queue_pauses": self._rows("queue_pauses", [{"queue": queue, "paused_at": self.clock()}])})

    def resume_queue(self, queue: str) -> None:
        self.store.commit({}, {"queue_pauses": self.spark.createDataFrame([(queue,)], "queue string")})

    def retry_dead_letter(self, run_id: str) -> None:
        base = self.store.version()
        t = self.tables(base)
        if lookups.get_run(t["runs"], run_id).filter("status = 'FAILED' AND dead_lettered_at > 0").isEmpty():
            raise NotDeadLetter(run_id)
        runs, steps = tr.revived(t["runs"], t["steps"], self._ids(run_id), self.clock())
        self.store.commit({"runs": runs, "steps": steps}, base=base)

    def dismiss_dead_letter(self, run_id: str) -> None:
        base = self.store.version()
        rows = settled(tr.dismissed(self.tables(base)["runs"], self._ids(run_id)))
        if rows.isEmpty():
            raise NotDeadLetter(run_id)
        self.store.commit({"runs": rows}, base=base)

    def _gone(self, t: dict[str, DataFrame], ids: DataFrame, keep_logs: bool) -> dict[str, DataFrame]:
        steps = settled(tr.of_runs(t["steps"], ids).select("id", "run_id"))
        own = steps.select(F.col("id").alias("step_id"))
        gone = {"runs": ids, "steps": steps.select("id"), "step_keys": t["step_keys"].join(own, "step_id", "left_semi"), "step_journal": t["step_journal"].join(own, "step_id", "left_semi")}
        if not keep_logs:
            gone["logs"] = t["logs"].join(ids.select(F.col("id").alias("run_id")), "run_id", "left_semi")
        return gone

    def purge(self, before: int, queue: str = "", keep_dead: bool = False, keep_logs: bool = False, statuses: tuple[str, ...] = TERMINAL) -> dict[str, int]:
        """Deletes ended runs that completed before a time, with all that belongs to them, older events, and logs without a run; numbers of rows."""
        if set(statuses) - set(TERMINAL):
            raise NonTerminalPurge(", ".join(sorted(set(statuses) - set(TERMINAL))))
        base = self.store.version()
        t = self.tables(base)
        ids = settled(tr.purgeable(t["runs"], t["steps"], before, queue, keep_dead).filter(F.col("status").isin(*statuses)).select("id"))
        gone = self._gone(t, ids, keep_logs)
        if not keep_logs:
            gone["logs"] = gone["logs"].select("seq").union(lookups.orphan_logs(t["logs"], t["runs"]).select("seq")).distinct()
        gone["events"] = t["events"].filter(F.col("created_at") < before)
        gone = {k: settled(v.select(*KEYS[k])) for k, v in gone.items()}
        counts = {k: v.count() for k, v in gone.items()}
        self.store.commit({}, {k: v for k, v in gone.items() if counts[k]}, base)
        return counts

    def retain(self, age_ns: int, **options) -> dict[str, int]:
        """One turn of the retention loop."""
        return self.purge(self.clock() - age_ns, **options)

    # Workers

    def heartbeat(self) -> None:
        self.store.commit({"steps": tr.beaten(self.tables()["steps"], self.worker, self.clock() + self.lease_ns)})

    def reap(self, limit: int = 200) -> int:
        base = self.store.version()
        t = self.tables(base)
        rows = settled(tr.reaped(t["steps"], t["runs"], self.clock(), limit))
        if rows.isEmpty():
            return 0
        self.store.commit({"steps": rows}, base=base)
        return rows.count()

    def close(self) -> None:
        """This worker's RUNNING steps are interrupted."""
        base = self.store.version()
        t = self.tables(base)
        runs, steps = tr.interrupted(t["runs"], t["steps"], self.worker)
        self.store.commit({"runs": runs, "steps": steps}, base=base)

    def recover(self, requeue: bool = True) -> None:
        base = self.store.version()
        t = self.tables(base)
        runs, steps, brief = tr.recovered(t["runs"], t["steps"], requeue, self.clock())
        self.store.commit({"runs": runs, "steps": steps}, self._gone(t, settled(brief), False), base)

    # Events and schedules

    def on(self, event: str, task: str) -> None:
        self.store.commit({"subscriptions": self._rows("subscriptions", [{"event": event, "task": task, "created_at": self.clock()}])})

    def off(self, event: str, task: str) -> None:
        self.store.commit({}, {"subscriptions": self.spark.createDataFrame([(event, task)], "event string, task string")})

    def emit(self, event: str, payload: Any = None) -> int:
        """Records the event, wakes those who wait for it, and starts a run for each binding whose task is registered; their number."""
        self._hook("before_emit", event, payload)
        base, now = self.store.version(), self.clock()
        t = self.tables(base)
        row = t["counters"].filter("name = 'events'").first()
        seq, text = (row["next"] if row else 1), self.codec.dumps(payload)
        waits = t["step_journal"].filter("kind = 'wait'")
        done, steps = tr.delivered(waits, t["steps"], t["runs"], event, text, now)
        self.store.commit({"events": self._rows("events", [{"seq": seq, "name": event, "payload": text, "created_at": now}]), "counters": self._rows("counters", [{"name": "events", "next": seq + 1}]), "step_journal": done, "steps": steps}, base=base)
        bound = [r["task"] for r in t["subscriptions"].filter(F.col("event") == event).orderBy("task").collect() if r["task"] in self.tasks]
        if bound:
            self.enqueue_batch([(name, payload) for name in bound])
        self._hook("after_emit", event, payload)
        return len(bound)

    def cron(self, name: str, spec: str, task: str, value: Any = None) -> None:
        now = self.clock()
        self.store.commit({"crons": self._rows("crons", [{"name": name, "spec": spec, "task": task, "input": self.codec.dumps(value), "next_at": next_fire(spec, now), "created_at": now}])})

    def remove_cron(self, name: str) -> None:
        self.store.commit({}, {"crons": self.spark.createDataFrame([(name,)], "name string")})

    def fire_crons(self) -> int:
        """A run for each due schedule whose task is registered, once for an occurrence: its time moves on in the same commit."""
        now = self.clock()
        due = [r for r in self.tables()["crons"].filter(F.col("next_at").between(1, now)).orderBy("name").collect() if r["task"] in self.tasks]
        if not due:
            return 0
        base, changed, gone, ids = self.stage([(r["task"], self.codec.loads(r["input"]), {}) for r in due])
        changed["crons"] = self._rows("crons", [r.asDict() | {"next_at": next_fire(r["spec"], now)} for r in due])
        self.commit((base, changed, gone, ids))
        return len(due)


def merged(table: DataFrame, changed: DataFrame, name: str) -> DataFrame:
    """The table with changed rows in place of those of equal keys."""
    return table.join(changed.select(*KEYS[name]), KEYS[name], "left_anti").select(*table.columns).unionByName(changed.select(*table.columns))
