"""One workflow's graph on the driver: building, checking, a snapshot with states, JSON and SVG. Specs are small."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from xml.sax.saxutils import escape

import numpy as np

from floeline.operators.graph import node_levels

#: Colours of the states in drawings.
COLOURS = {"SUCCEEDED": "#2e7d32", "FAILED": "#c62828", "RUNNING": "#1565c0", "CANCELLED": "#757575", "INTERRUPTED": "#ef6c00", "SUSPENDED": "#6a1b9a"}
#: Bounds of a run tree: levels, nodes and children of a run: fixed values.
TREE_DEPTH, TREE_NODES, TREE_CHILDREN = 8, 2000, 200


class InvalidGraph(ValueError):
    """A graph without steps, with a doubled or empty name, an unknown dependency, or a cycle."""


@dataclass
class Node:
    name: str
    deps: list[str] = field(default_factory=list)
    status: str = ""
    group: str = ""
    task: str = ""
    attempts: int = 0
    error: str = ""


@dataclass
class Group:
    name: str
    steps: list[str] = field(default_factory=list)
    after: list[str] = field(default_factory=list)
    status: str = ""
    label: str = ""
    parent: str = ""


@dataclass
class Graph:
    nodes: list[Node]
    groups: list[Group] = field(default_factory=list)
    edges: list[tuple[str, str]] = field(default_factory=list)

    def json(self) -> str:
        return json.dumps({"nodes": [asdict(n) for n in self.nodes], "edges": [{"from": a, "to": b} for a, b in self.edges], "groups": [asdict(g) for g in self.groups]}, indent=2, ensure_ascii=False)

    def levels(self) -> dict[str, int]:
        """The longest path to each node from one without dependencies; 0 on cycles."""
        number = {n.name: k for k, n in enumerate(self.nodes)}
        pairs = [(k, number[d]) for k, n in enumerate(self.nodes) for d in n.deps if d in number]
        of, dep = (np.array([p[i] for p in pairs], dtype=np.int64) for i in range(2))
        made = node_levels(np.zeros(len(self.nodes), dtype=np.int64), np.arange(len(self.nodes)), of, dep)
        return {n.name: int(v) for n, v in zip(self.nodes, made, strict=True)}

    def svg(self, width: int = 170, height: int = 34, gap: int = 26) -> str:
        """Columns by level, rows in order; right-angled edges with a lane each; group boxes behind, states by colour, and a legend."""
        level, rows, at = self.levels(), {}, {}
        for n in sorted(self.nodes, key=lambda n: (n.group, n.name)):
            column = level[n.name]
            at[n.name] = (gap + column * (width + 2 * gap), 2 * gap + rows.get(column, 0) * (height + gap))
            rows[column] = rows.get(column, 0) + 1
        wide = 2 * gap + (max(level.values(), default=0) + 1) * (width + 2 * gap)
        tall = 4 * gap + max(rows.values(), default=0) * (height + gap)
        out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide}" height="{tall}" font-family="sans-serif" font-size="12">']
        for g in self.groups:
            spots = [at[n.name] for n in self.nodes if n.group == g.name and n.name in at]
            if spots:
                x0, y0, x1, y1 = min(x for x, _ in spots), min(y for _, y in spots), max(x for x, _ in spots), max(y for _, y in spots)
                out.append(f'<rect x="{x0 - 8}" y="{y0 - 16}" width="{x1 - x0 + width + 16}" height="{y1 - y0 + height + 24}" rx="6" fill="none" stroke="{COLOURS.get(g.status, "#bbb")}" stroke-dasharray="4"/><text x="{x0 - 4}" y="{y0 - 4}" fill="#555">{escape(shortened(g.label or g.name))}</text>')
        for lane, (a, b) in enumerate(self.edges):
            if a in at and b in at:
                (x0, y0), (x1, y1) = at[a], at[b]
                middle = x1 - gap - lane % 7 * 3
                out.append(f'<path d="M {x0 + width} {y0 + height // 2} H {middle} V {y1 + height // 2} H {x1}" fill="none" stroke="#999"/>')
        for n in self.nodes:
            x, y = at[n.name]
            out.append(f'<rect x="{x}" y="{y}" width="{width}" height="{height}" rx="5" fill="#fff" stroke="{COLOURS.get(n.status, "#999")}" stroke-width="2"><title>{escape(n.error or n.status)}</title></rect><text x="{x + 8}" y="{y + height // 2 + 4}">{escape(shortened(n.name))}</text>')
        for k, (status, colour) in enumerate(COLOURS.items()):
            out.append(f'<text x="{gap + k * 100}" y="{tall - 8}" fill="{colour}">{status}</text>')
        return "\n".join([*out, "</svg>"])


def shortened(text: str, most: int = 24) -> str:
    return text if len(text) <= most else text[: most - 1] + "…"


def deduped(names: list[str]) -> list[str]:
    return list(dict.fromkeys(names))


def checked(nodes: list[Node]) -> list[Node]:
    """The nodes in an order that respects dependencies (names break ties); InvalidGraph otherwise."""
    if not nodes:
        raise InvalidGraph("no steps")
    by = {n.name: n for n in nodes}
    if "" in by or len(by) < len(nodes):
        raise InvalidGraph("step names must be given and differ")
    for n in nodes:
        for d in n.deps:
            if d not in by:
                raise InvalidGraph(f"{n.name} depends on {d}, which is not there")
    waits = {n.name: set(n.deps) for n in nodes}
    out: list[Node] = []
    while waits:
        free = sorted(name for name, w in waits.items() if not w)
        if not free:
            raise InvalidGraph(f"a cycle among {', '.join(sorted(waits))}")
        for name in free:
            out.append(by[name])
            del waits[name]
        for w in waits.values():
            w.difference_update(free)
    return out


def expanded(groups: list[Group], nodes: list[Node]) -> list[Node]:
    """Every step of a group also waits for all steps of the groups that it comes after."""
    by = {g.name: g for g in groups}
    if "" in by or len(by) < len(groups):
        raise InvalidGraph("group names must be given and differ")
    for g in groups:
        for a in g.after:
            if a not in by:
                raise InvalidGraph(f"group {g.name} comes after {a}, which is not there")
    of = {s: g for g in groups for s in g.steps}
    return [Node(**{**asdict(n), "deps": deduped([*n.deps, *(s for a in (of[n.name].after if n.name in of else []) for s in by[a].steps)]), "group": of[n.name].name if n.name in of else n.group}) for n in nodes]


def rollup(statuses: list[str], none: str = "") -> str:
    """One state for several."""
    if not statuses:
        return none
    for s in ("FAILED", "CANCELLED", "INTERRUPTED"):
        if s in statuses:
            return s
    return "SUCCEEDED" if set(statuses) == {"SUCCEEDED"} else "RUNNING"


def snapshot(nodes: list[Node], groups: list[Group]) -> Graph:
    """Edges between steps of one group or of none, and between groups; groups have the state of their steps."""
    of, state = {s: g.name for g in groups for s in g.steps}, {n.name: n.status for n in nodes}
    edges = [(d, n.name) for n in nodes for d in n.deps if not (d in of and n.name in of and of[d] != of[n.name])]
    edges += [(a, g.name) for g in groups for a in g.after]
    return Graph(nodes, [Group(g.name, g.steps, g.after, rollup([state[s] for s in g.steps if s in state]), g.label, g.parent) for g in groups], edges)


def short_id(run_id: str) -> str:
    """What follows the last hyphen, at most its last six characters."""
    return run_id.rsplit("-", 1)[-1][-6:]


def tree(run_id: str, steps_of, children_of, deep: int = TREE_DEPTH, most: int = TREE_NODES, kids: int = TREE_CHILDREN) -> Graph:
    """A run with the runs that it started: a step that started runs becomes a group, and what depended on it depends on the group.

    ``steps_of(run_id)``: [Node]; ``children_of(run_id, limit)``: [(run_id, parent_step, status)], oldest first.
    """
    out, seen = Graph([]), set()

    def add(rid: str, prefix: str, group: str, depth: int) -> None:
        if depth > deep or rid in seen or len(out.nodes) >= most:
            return
        seen.add(rid)
        steps, started = steps_of(rid), {}
        for child, step, status in children_of(rid, kids):
            started.setdefault(step, []).append((child, status))
        box = {prefix + step: f"{rid}/{step}" for step in started if step}
        to = lambda name: box.get(prefix + name, prefix + name)
        for s in steps:
            if prefix + s.name not in box:
                deps = [to(d) for d in s.deps]
                out.nodes.append(Node(prefix + s.name, deps, s.status, group, s.task, s.attempts, s.error))
                out.edges += [(d, prefix + s.name) for d in deps]
        deps_of = {s.name: s.deps for s in steps}
        for step, runs in started.items():
            name, deps = f"{rid}/{step}", deduped([to(d) for d in deps_of.get(step, [])])
            label = f"{len(runs)} child runs"
            out.groups.append(Group(name, [], deps, rollup([s for _, s in runs], "SUCCEEDED"), f"{step} → {label}" if step else label, group))
            out.edges += [(d, name) for d in deps]
            for child, _ in runs:
                add(child, f"{prefix}{short_id(child)}/", name, depth + 1)

    add(run_id, "", "", 0)
    return out
