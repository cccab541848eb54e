"""Connected components of an edge table, by joins; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floeline.llm.shared import light, release, settled


def _edges(a: Column, b: Column, table: DataFrame, rows: int | None) -> DataFrame:
    """Distinct (a, b), the smaller node first, without loops."""
    return settled(table.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a != b").distinct(), rows)


def _jump(label: DataFrame, by: DataFrame, rows: int | None = None) -> DataFrame:
    """Each label is replaced by its own label; ``rows``: a bound of ``by``."""
    roots = light(by.select(F.col("node").alias("root"), F.col("comp").alias("next")), rows)
    return label.join(roots, F.col("comp") == F.col("root"), "left").select("node", F.coalesce("next", "comp").alias("comp"))


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b), ``rows`` at most; comp is the smallest node that it reaches.

    By contraction: every node goes to the smallest of its neighbours and itself, then to where that
    one goes (pointer jumping, three steps); edges are rewritten to what their ends went to, and loops and
    doubles leave. Only nodes without a smaller neighbour remain, and rounds go on until no edge is left.
    Minima come by partial sums, so a node of many edges never meets them in one task.
    """
    edges = _edges(F.col("a"), F.col("b"), edges, rows)
    left = edges.count()
    label, most = None, 2 * left
    while left:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        goes = settled(both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("comp")), 2 * left)
        goes = settled(_jump(_jump(goes, goes, 2 * left), goes, 2 * left), 2 * left)
        # All nodes of a contracted graph are labels so far.
        label = goes if label is None else settled(_jump(label, goes, 2 * left), most)
        to = lambda end, name: light(goes.select(F.col("node").alias(end), F.col("comp").alias(name)), 2 * left)  # noqa: B023, E731
        ends = edges.join(to("a", "x"), "a").join(to("b", "y"), "b")
        edges = _edges(F.col("x"), F.col("y"), ends, left)
        left = edges.count()
        release(edges.sparkSession)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")) if label is None else label


def joined(label: DataFrame, links: DataFrame, rows: int) -> DataFrame:
    """The components (node, comp) after further edges (a, b), ``rows`` at most; only these are worked on."""
    had = label.count()
    for end in ("a", "b"):
        known = light(label.select(F.col("node").alias(end), F.col("comp").alias("to")), had)
        links = links.join(known, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    goes = components(links, rows)
    # Nodes without a label so far are their own components.
    new = goes.join(light(label.select("node"), had), "node", "left_anti")
    return settled(_jump(label, goes, 2 * rows).union(new), had + 2 * rows)
