"""The engine end to end on small state, and its parts against plain expectations."""

import json
import random

import pytest

from floeline.engine import Engine
from floeline.operators import dag
from floeline.operators import transitions as tr
from floeline.sources.store import CommitConflict
from floeline.tasks import DuplicateJob, NotDeadLetter, RunCancelled, RunError, RunTerminal, Task, Workflow, constant


class Clock:
    def __init__(self):
        self.now = 1_000_000_000_000

    def __call__(self):
        self.now += 1
        return self.now


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, f"file://{tmp_path}/state", clock=Clock())


def test_a_workflow_of_groups_runs_in_order(spark, engine):
    rows = Task("rows", lambda ctx, n: ctx.spark.range(n))
    total = Task("total", lambda ctx, n: sum(ctx.dep(d).count() for d in ctx.deps))
    flow = Workflow("elt").group("extract", [("e1", rows), ("e2", rows)]).group("load", [("l1", total)], after=("extract",))
    handle = engine.enqueue(flow, 7)
    engine.run_until_idle()
    assert handle.done() and handle.result() == 14
    graph = engine.graph(handle.run_id)
    assert graph.edges == [("extract", "load")] and {g.name: g.status for g in graph.groups} == {"extract": "SUCCEEDED", "load": "SUCCEEDED"}
    assert json.loads(graph.json())["groups"][1]["after"] == ["extract"] and graph.svg().count("<rect") == 5
    assert engine.metrics()["runs"] == {"SUCCEEDED": 1}


def test_retries_failures_and_dead_letters(engine):
    tries = []

    def flaky(ctx, n):
        tries.append(ctx.attempt)
        if len(tries) < n:
            raise ValueError("not yet")
        return "ok"

    task = Task("flaky", flaky, retries=1, backoff=constant(50), dead_letter=True)
    handle = engine.enqueue(task, 3)
    engine.tick()
    engine.clock.now += 1000
    engine.run_until_idle()
    with pytest.raises(RunError, match="not yet"):
        handle.result()
    assert tries == [1, 2] and engine.dead_letters().count() == 1
    engine.retry_dead_letter(handle.run_id)
    engine.run_until_idle()
    assert handle.result() == "ok"
    with pytest.raises(NotDeadLetter):
        engine.retry_dead_letter(handle.run_id)


def test_durable_steps_wait_and_remember(engine):
    made = []

    def body(ctx, value):
        first = ctx.once("draw", lambda: made.append(1) or len(made))
        got = ctx.wait_for("paid")
        ctx.log(f"got {got}")
        return [first, got]

    handle = engine.enqueue(Task("order", body), None)
    engine.emit("paid", "too early")
    engine.run_until_idle()
    assert not handle.done() and engine.steps(handle.run_id)[0]["status"] == "SUSPENDED"
    engine.emit("paid", 5)
    engine.run_until_idle()
    assert handle.result() == [1, 5] and made == [1]
    assert [r.message for r in engine.logs(run_id=handle.run_id).collect()] == ["got 5"]


def test_unique_runs_and_control(engine):
    task = Task("one", lambda ctx, v: v, unique=lambda v: v["k"])
    a, b = engine.enqueue_batch([(task, {"k": "x"}), (task, {"k": "x"})])
    assert a.run_id == b.run_id and engine.enqueue(task, {"k": "x"}).run_id == a.run_id
    task.unique_conflict = "error"
    with pytest.raises(DuplicateJob):
        engine.enqueue(task, {"k": "x"})
    engine.pause_queue("default")
    assert engine.tick() == 0 and engine.paused_queues() == ["default"]
    engine.resume_queue("default")
    engine.pause_run(a.run_id)
    assert engine.tick() == 0
    engine.resume_run(a.run_id)
    engine.cancel(a.run_id)
    with pytest.raises(RunCancelled):
        a.result()
    with pytest.raises(RunTerminal):
        engine.pause_run(a.run_id)
    counts = engine.purge(engine.clock() + 1)
    assert (counts["runs"], counts["steps"]) == (1, 1) and engine.runs().count() == 0


def test_children_events_and_schedules(engine):
    child = Task("child", lambda ctx, v: v)
    parent = Workflow("parent").step("plan", Task("plan", lambda ctx, v: None)).step("fan", Task("fan", lambda ctx, v: [ctx.spawn(child, k).run_id for k in range(2)]), "plan").step("end", Task("end", lambda ctx, v: 1), "fan")
    engine.register(child)
    engine.on("go", "child")
    assert engine.emit("go", 1) == 1
    engine.cron("each", "@every 1s", "child", 3)
    engine.clock.now += 2_000_000_000
    assert engine.fire_crons() == 1 and engine.fire_crons() == 0
    handle = engine.enqueue(parent)
    engine.run_until_idle()
    tree = engine.tree(handle.run_id)
    group = f"{handle.run_id}/fan"
    assert [g.name for g in tree.groups] == [group] and set(tree.edges) == {("plan", group), (group, "end")}
    assert len([n for n in tree.nodes if n.group == group]) == 2


def test_commits_conflict_and_versions_stay(engine):
    handle = engine.enqueue(Task("t", lambda ctx, v: v), 1)
    version = engine.store.version()
    staged = engine.stage([(Task("u", lambda ctx, v: v), 2, {})])
    engine.run_until_idle()
    with pytest.raises(CommitConflict):
        engine.commit(staged)
    assert engine.tables(version)["runs"].first()["status"] == "QUEUED" and handle.result() == 1
    assert {(r.step, r.status) for r in engine.transitions(version, handle.run_id).collect()} == {("", "SUCCEEDED"), ("t", "SUCCEEDED")}


RUN = "id string, status string, error string, attempts long, run_at long, completed_at long, dead_lettered_at long"
STEP = "id string, run_id string, name string, ord long, status string, depends_on string, error string, worker_id string, attempts long, max_attempts long, run_at long, claimed_at long, completed_at long, lease_expires_at long, resume_at long, wait_kind string, wait_event string"


def _state(spark, runs, steps):
    r = spark.createDataFrame([(i, s, "", 1, 0, 0, 0) for i, s in runs], RUN)
    return r, spark.createDataFrame([(f"{run}/{n}", run, n, k, s, "", "", w, 1, 2, 0, 0, 0, 9 if s == "RUNNING" else 0, 0, "", "") for k, (run, n, s, w) in enumerate(steps)], STEP)


def test_interrupts_leave_runs_that_go_on_elsewhere(spark):
    runs, steps = _state(spark, [("a", "RUNNING"), ("b", "RUNNING"), ("c", "PAUSED")], [("a", "x", "RUNNING", "w1"), ("a", "y", "RUNNING", "w2"), ("b", "x", "RUNNING", "w1"), ("c", "x", "RUNNING", "w1")])
    over, ends = tr.interrupted(runs, steps, "w1")
    assert [r.id for r in over.collect()] == ["b"] and sorted(r.id for r in ends.collect()) == ["a/x", "b/x", "c/x"]


def test_a_final_failure_ends_its_run(spark):
    runs, steps = _state(spark, [("a", "RUNNING"), ("b", "RUNNING")], [("a", "x", "RUNNING", ""), ("a", "y", "BLOCKED", ""), ("a", "z", "SUCCEEDED", ""), ("b", "x", "RUNNING", "")])
    over, ends = tr.finally_failed(runs, steps, spark.createDataFrame([("a/x", "boom")], "id string, error string"), 5, True)
    assert [(r.id, r.status, r.error, r.dead_lettered_at) for r in over.collect()] == [("a", "FAILED", "boom", 5)]
    assert sorted((r.id, r.status, r.error) for r in ends.collect()) == [("a/x", "FAILED", "boom"), ("a/y", "CANCELLED", "")]


def test_checked_graphs(spark):
    for nodes in ([], [dag.Node("a", ["b"]), dag.Node("b", ["a"])], [dag.Node("a"), dag.Node("a")], [dag.Node("a", ["gone"])]):
        with pytest.raises(dag.InvalidGraph):
            dag.checked(nodes)
    for seed in (1, 7, 42):
        rng = random.Random(seed)
        nodes = [dag.Node(f"n{k}", sorted({f"n{rng.randrange(k)}" for _ in range(rng.randrange(3))})) if k else dag.Node("n0") for k in range(100)]
        rng.shuffle(nodes)
        order = [n.name for n in dag.checked(nodes)]
        level = dag.Graph(nodes).levels()
        assert all(order.index(d) < order.index(n.name) and level[d] < level[n.name] for n in nodes for d in n.deps)
        assert all(level[n.name] == max((level[d] + 1 for d in n.deps), default=0) for n in nodes)
