"""Tasks, workflows and groups as users write them, and what a running step sees."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from floeline.operators.dag import Group, Node, checked, expanded


class RunError(RuntimeError):
    """The run failed."""


class RunCancelled(RunError):
    pass


class RunInterrupted(RunError):
    pass


class NotFound(KeyError):
    pass


class RunRunning(RuntimeError):
    """A step of the run is running."""


class RunTerminal(RuntimeError):
    """The run has ended."""


class NotDeadLetter(RuntimeError):
    pass


class NonTerminalPurge(RuntimeError):
    """Only ended runs can be deleted."""


class DuplicateJob(RuntimeError):
    """A live run holds the unique key."""


class UnknownTask(KeyError):
    pass


class WaitTimeout(TimeoutError):
    pass


class JournalMisaligned(RuntimeError):
    """A replay asked for something else than the journal holds at that place."""


class Veto(RuntimeError):
    """Raised by a hook that refuses."""


class Suspended(BaseException):
    """Ends a step's function until a time or an event; not an error."""

    def __init__(self, kind: str, event: str = "", resume_at: int = 0):
        self.kind, self.event, self.resume_at = kind, event, resume_at


@dataclass
class Backoff:
    base_ns: int = 500_000_000
    factor: float = 2.0
    most_ns: int = 30_000_000_000


def exponential(base_ns: int, most_ns: int = 30_000_000_000) -> Backoff:
    return Backoff(base_ns, 2.0, most_ns)


def constant(delay_ns: int) -> Backoff:
    return Backoff(delay_ns, 1.0, delay_ns)


@dataclass
class Task:
    """``fn(ctx, input)``; ``retries`` further tries. Keys are functions of the input.

    ``key``: concurrency key with ``key_limit`` RUNNING steps at a time and, with a ``key_strategy``, as many live runs;
    ``keys``: further named keys {name: (function, limit)}; ``unique``: one live run per value; ``sequence``: in order of enqueueing.
    """

    name: str
    fn: Callable[..., Any]
    retries: int = 0
    backoff: Backoff = field(default_factory=Backoff)
    queue: str = "default"
    key: Callable[[Any], str] | None = None
    key_limit: int = 1
    key_strategy: str = ""
    keys: dict[str, tuple[Callable[[Any], str], int]] = field(default_factory=dict)
    unique: Callable[[Any], str] | None = None
    unique_conflict: str = "reuse"
    sequence: Callable[[Any], str] | None = None
    ephemeral: bool = False
    dead_letter: bool = False
    labels: tuple[str, ...] = ()
    timeout_ns: int = 0
    wrap: tuple[Callable, ...] = ()

    @property
    def steps(self) -> list[tuple[Node, Task]]:
        return [(Node(self.name), self)]

    groups: tuple = ()


class Workflow:
    """Steps that depend on steps; ``step`` returns the workflow, so calls can be chained."""

    def __init__(self, name: str, ephemeral: bool = False, dead_letter: bool = False):
        self.name, self.ephemeral, self.dead_letter = name, ephemeral, dead_letter
        self.nodes: list[Node] = []
        self.tasks: dict[str, Task] = {}
        self.groups: list[Group] = []

    def step(self, name: str, task: Task, *deps: str) -> Workflow:
        self.nodes.append(Node(name, list(deps), task=task.name))
        self.tasks.setdefault(name, task)
        return self

    def group(self, name: str, steps: list[tuple], after: tuple[str, ...] = ()) -> Workflow:
        """Steps (name, task, *deps) that start when all steps of the groups ``after`` have succeeded."""
        for s in steps:
            self.step(*s)
        self.groups.append(Group(name, [s[0] for s in steps], list(after)))
        return self

    @property
    def steps(self) -> list[tuple[Node, Task]]:
        return [(n, self.tasks[n.name]) for n in checked(expanded(self.groups, self.nodes))]


class Json:
    """The codec of payloads."""

    name = "json"

    def dumps(self, value: Any) -> str:
        return json.dumps(value)

    def loads(self, text: str | None) -> Any:
        return None if text is None else json.loads(text)


@dataclass
class Context:
    """What a step's function gets: who it is, its dependencies' outputs, durable helpers and children."""

    engine: Any
    run_id: str
    step_id: str
    name: str
    attempt: int
    deps: list[str]
    journal: dict[int, dict]
    now: int
    lines: list[tuple[str, str]] = field(default_factory=list)
    written: dict[int, dict] = field(default_factory=dict)
    at: int = 0

    @property
    def spark(self):
        return self.engine.spark

    def log(self, message: str, level: str = "INFO") -> None:
        self.lines.append((level, message))

    def dep(self, name: str) -> Any:
        """The output of a declared dependency; a table comes back as a DataFrame."""
        if name not in self.deps:
            raise NotFound(f"{self.name} does not depend on {name}")
        return self.engine.output(self.run_id, name)

    def _entry(self, kind: str, key: str = "", event: str = "") -> tuple[int, dict | None]:
        at, self.at = self.at, self.at + 1
        found = self.journal.get(at)
        if found and (found["kind"], found["wkey"] or "", found["event"] or "") != (kind, key, event):
            raise JournalMisaligned(f"{self.step_id} at {at}: {kind} {key or event}, the journal has {found['kind']}")
        return at, found

    def _write(self, at: int, **values) -> dict:
        entry = {"step_id": self.step_id, "idx": at, "kind": "", "wkey": "", "event": "", "wake_at": 0, "deadline": 0, "registered": self.now, "payload": None, "result": None, "err": "", "done": False, "timed_out": False}
        self.written[at] = entry | self.journal.get(at, {}) | values
        return self.written[at]

    def once(self, key: str, fn: Callable[[], Any]) -> Any:
        """``fn``'s result, computed once over all tries; an error leaves it to be computed again."""
        at, found = self._entry("once", key)
        if found and found["done"]:
            return self.engine.codec.loads(found["result"])
        made = fn()
        self._write(at, kind="once", wkey=key, result=self.engine.codec.dumps(made), done=True)
        return made

    def sleep(self, ns: int) -> None:
        """Sleeps without a worker; the time to wake is fixed at the first call."""
        at, found = self._entry("sleep")
        wake = found["wake_at"] if found else self.now + ns
        if ns <= 0 or wake <= self.now:
            self._write(at, kind="sleep", wake_at=wake, done=True)
            return
        self._write(at, kind="sleep", wake_at=wake)
        raise Suspended("sleep", resume_at=wake)

    def wait_for(self, event: str, timeout_ns: int = 0) -> Any:
        """The payload of the first such event after this call; WaitTimeout once the deadline has passed."""
        at, found = self._entry("wait", event=event)
        if found and found["done"]:
            if found["timed_out"]:
                raise WaitTimeout(event)
            return self.engine.codec.loads(found["payload"])
        deadline = found["deadline"] if found else (self.now + timeout_ns if timeout_ns > 0 else 0)
        if found and 0 < deadline <= self.now:
            self._write(at, kind="wait", event=event, deadline=deadline, done=True, timed_out=True)
            raise WaitTimeout(event)
        if not found:
            self._write(at, kind="wait", event=event, deadline=deadline)
        raise Suspended("wait", event, deadline)

    def spawn(self, work: Task | Workflow, value: Any = None, **options):
        """A child run; its parent is this run's step."""
        return self.engine.enqueue(work, value, parent=(self.run_id, self.name), **options)
