"""Graphs over step and run tables: levels of steps, trees of runs, edges between steps and groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.operators.transitions import needs
from floeline.sources.shared import settled

#: Nodes that are levelled at once; a run is never cut.
NODES = 200_000


def _codes(*columns: pa.Array) -> list[np.ndarray]:
    """The same number for equal values, over several columns."""
    every = pa.concat_arrays([c.cast(pa.string()) for c in columns]).dictionary_encode().indices.to_numpy()
    return np.split(every, np.cumsum([len(c) for c in columns])[:-1])


def node_levels(run: np.ndarray, name: np.ndarray, of: np.ndarray, dep: np.ndarray) -> np.ndarray:
    """Levels of nodes (run, name): the longest path from a node without dependencies; ``dep[k]`` is a dependency's name of node ``of[k]``.

    Nodes are settled in rounds once all they depend on is. Dangling dependencies count for nothing; nodes
    that never settle (on a cycle, or after one) have level 0.
    """
    most = int(max(name.max(initial=0), dep.max(initial=0))) + 1
    key = run.astype(np.int64) * most + name
    order = np.argsort(key)
    wanted = run[of].astype(np.int64) * most + dep
    at = np.minimum(np.searchsorted(key[order], wanted), max(0, len(key) - 1))
    real = key[order][at] == wanted if len(key) else np.zeros(0, dtype=bool)
    src, dst = order[at[real]], of[real]
    by = np.argsort(src, kind="stable")
    src, dst = src[by], dst[by]
    first, last = np.searchsorted(src, np.arange(len(key))), np.searchsorted(src, np.arange(len(key)), side="right")
    waits, level = np.bincount(dst, minlength=len(key)), np.zeros(len(key), dtype=np.int64)
    now, depth = np.flatnonzero(waits == 0), 0
    while len(now):
        sizes = last[now] - first[now]
        out = dst[np.repeat(first[now] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
        np.subtract.at(waits, out, 1)
        depth += 1
        now = np.unique(out)
        now = now[waits[now] == 0]
        level[now] = depth
    return level


def levels(steps: DataFrame) -> DataFrame:
    """(run_id, name, level) of steps (run_id, name, depends_on).

    Steps of a run are few (the engine's bound is 10,000), so one shuffle brings each run together and
    whole runs are levelled in batches; depth costs no further job.
    """
    rows = steps.select("run_id", "name", needs(steps).alias("deps")).repartition("run_id").sortWithinPartitions("run_id")

    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        runs, names, deps = (table.column(c).combine_chunks() for c in ("run_id", "name", "deps"))
        name, dep = _codes(names, deps.flatten())
        of = np.repeat(np.arange(len(name)), deps.value_lengths().to_numpy(zero_copy_only=False))
        level = node_levels(_codes(runs)[0], name, of, dep)
        return pa.record_batch([runs, names, pa.array(level)], names=["run_id", "name", "level"])

    def batched(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= NODES:
                table = pa.Table.from_batches(held)
                runs = table.column("run_id").combine_chunks().dictionary_encode().indices.to_numpy()
                cut = int(np.searchsorted(runs, runs[-1]))  # numbers come in order of appearance
                if cut:
                    yield solve(table.slice(0, cut))
                    held, size = table.slice(cut).to_batches(), size - cut
        if held and size:
            yield solve(pa.Table.from_batches(held))

    return rows.mapInArrow(batched, "run_id string, name string, level long")


def step_edges(steps: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(run_id, src, dst): dependencies of steps; with ``groups`` (run_id, step, grp) without those that cross from group to group."""
    edges = steps.select("run_id", F.explode(needs(steps)).alias("src"), F.col("name").alias("dst"))
    if groups is None:
        return edges
    of = lambda end: groups.select("run_id", F.col("step").alias(end), F.col("grp").alias(f"{end}_grp"))
    met = edges.join(of("src"), ["run_id", "src"], "left").join(of("dst"), ["run_id", "dst"], "left")
    return met.filter(F.col("src_grp").isNull() | F.col("dst_grp").isNull() | (F.col("src_grp") == F.col("dst_grp"))).select("run_id", "src", "dst")


def run_tree(runs: DataFrame, roots: DataFrame | None = None, deep: int = 8) -> DataFrame:
    """(id, root, depth): runs below the roots (default: runs without a parent), at most ``deep`` levels.

    Each level joins only the runs found last; the parents are read once. No bound on rows.
    """
    pairs = settled(runs.filter("parent_id != ''").select("id", "parent_id"))
    front = settled((runs.filter("parent_id = ''") if roots is None else roots).select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth")))
    found = front
    for depth in range(1, deep + 1):
        front = settled(pairs.join(front.select(F.col("id").alias("parent_id"), "root"), "parent_id").select("id", "root", F.lit(depth).cast("long").alias("depth")))
        if front.isEmpty():
            break
        found = found.union(front)
    return found
