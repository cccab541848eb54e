"""Mixing sources to target weights by entropy balancing. DataFrame operations only.

Every document gets a rate r between 0 and ``most``, the expected number of its
copies in the mix. Among all rates that meet the token target of each source,
those are taken that stay closest to 1 in (bounded) relative entropy. The dual
of this convex problem has one variable for each source; its solution tilts the
rates exponentially in the document's size: r = most / (1 + (most - 1) exp(-x)),
x = lambda * size / scale. Newton's iterations run over the histogram
(source, size, documents), which is all that the sums depend on, so that each
step is one small aggregation with partial sums; a source is never gathered in
a task. Rates are then rounded into copies for each cell (source, size), in order
of falling size over all sizes of a source, carrying what was rounded off, so
that a source ends within a fraction of a small document of its target. Within a cell the further copies go to documents by
hash order, dealt over salts by the cell's size so that a large cell never has
to be sorted in one task.

Defined cases: null text counts as empty (size 0, never taken); a null source
is a source of its own and comes last; an empty table gives an empty result;
repeated rows and rows that share an id are documents of their own, without id too;
documents of equal size in a source tie and are told apart by a hash of their id; other
columns, of any name, are not read. Sources are taken to be few enough to be sorted in one task
(one row each); their documents are not.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floeline.llm.shared import documents, estimated, fresh, release, small

#: Every so many steps of Newton, which never leave the bracket of the root, the bracket is halved instead, so that they end.
HALVING = 4
#: Sizes that one block of the rounding's fold holds. A source of n distinct sizes has over n * n / 2 words, so all its sizes fit in an array.
BLOCK_SIZES = 512
#: Documents of a cell that one salt should hold.
SALT_ROWS = 50_000
#: Cells (60 bytes each) up to which they are broadcast, so that a large cell meets them where its rows are.
CELLS = 500_000
#: Bracket of the scaled dual variable: beyond it all rates are 0 or the most.
_REACH = 60.0


def word_count(text: Column | str) -> Column:
    """Number of maximal runs of characters other than 0x20 and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """One row per source: source, source_size, docs, target.

    Sources in order of code points, null last, take ``weights`` in turn. The
    total is ``share`` of all sizes. A target is at most ``most`` times its source's size;
    the excess goes to the others by weight until none is above, which is
    min(cap, level * weight) for the level that spends the total.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    every = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(turn, ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
    # With all sources before this one at their caps, the level of the rest:
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", left / weight_left)
    # The first source that its level does not cap fixes the level of all that follow.
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    per = per.withColumn("at", F.first(free, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return per.select("source", "source_size", "docs", F.coalesce(F.least(F.col("cap"), F.col("at") * F.col("weight")), F.col("cap")).alias("target"))


def _rate(x: Column, most: float) -> Column:
    return F.lit(most) / (F.lit(1.0) + F.lit(most - 1.0) * F.exp(-x))


def dual(histogram: DataFrame, goals: DataFrame, most: float = 3.0) -> DataFrame:
    """One row per source: source, lam (the dual variable over the mean size), scale.

    ``histogram``: source, size, docs. Newton's step is taken where it stays in the
    bracket that earlier residuals leave, else the bracket's middle, until every source
    meets its target (to a billionth) or its bracket is closed.
    """
    tilt = goals.select(
        "source",
        "target",
        F.greatest(F.lit(1.0), F.col("source_size") / F.col("docs")).alias("scale"),
        F.lit(0.0).alias("lam"),
        F.lit(-_REACH).alias("low"),
        F.lit(_REACH).alias("high"),
        F.lit(False).alias("done"),
    )
    # Whatever is known of a source travels through the aggregation, so a step is one join with a row a source.
    known = ("target", "scale", "lam", "low", "high", "done")
    for step in itertools.count():
        x = F.col("lam") * F.col("size") / F.col("scale")
        rate = _rate(x, most)
        tilt = (
            histogram.join(tilt.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
            .groupBy("source")
            .agg(
                *[F.first(c).alias(c) for c in known],
                F.sum(F.col("docs") * F.col("size") * rate).alias("taken"),
                F.sum(F.col("docs") * F.col("size") * F.col("size") / F.col("scale") * rate * (F.lit(1.0) - rate / most)).alias("slope"),
            )
        )
        short = F.coalesce("taken", F.lit(0.0)) < F.col("target")
        low, high = F.when(short, F.col("lam")).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.col("lam"))
        tilt = tilt.withColumns({"low": low, "high": high, "next": F.col("lam") + (F.col("target") - F.col("taken")) / F.nullif("slope", F.lit(0.0))})
        inside = (F.col("next") > F.col("low")) & (F.col("next") < F.col("high"))
        done = (F.abs(F.col("taken") - F.col("target")) <= F.lit(1e-9) * F.col("target")) | (F.col("high") - F.col("low") < F.lit(1e-12))
        newton = inside & F.lit(step % HALVING != HALVING - 1 or step < 2 * HALVING)
        moved = F.when(done, F.col("lam")).when(newton, F.col("next")).otherwise((F.col("low") + F.col("high")) / 2)
        tilt = tilt.select("source", "target", "scale", moved.alias("lam"), "low", "high", done.alias("done"))
        if step % 2:
            tilt = estimated(tilt)
            if tilt.filter("NOT done").isEmpty():
                return tilt
            release(tilt.sparkSession)


def _spread(cells: DataFrame, most: int) -> DataFrame:
    """Adds ``copies`` of each cell (source, size, docs, wish): whole numbers from 0 to most * docs.

    All sizes of a source are folded in order of falling size with the carry of all
    that was rounded before.
    """
    by_source = cells.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("k"), "size", "docs", "wish"))).alias("cells"))

    def put(carry: Column, cell: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.round(cell["wish"] + carry / cell["size"]), (F.lit(most) * cell["docs"]).cast("double")))

    # A running fold that keeps the copies of each cell; full blocks are set aside, so that no long array is copied for each cell.
    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<bigint>").alias("block"), F.array().cast("array<array<bigint>>").alias("full"))

    def fold(acc: Column, cell: Column) -> Column:
        copies = put(acc["carry"], cell)
        made = F.array(copies.cast("long"))
        ends = F.size(acc["block"]) >= BLOCK_SIZES
        return F.struct(
            (acc["carry"] + (cell["wish"] - copies) * cell["size"]).alias("carry"),
            F.when(ends, made).otherwise(F.concat(acc["block"], made)).alias("block"),
            F.when(ends, F.concat(acc["full"], F.array(acc["block"]))).otherwise(acc["full"]).alias("full"),
        )

    folded = by_source.withColumn("made", F.aggregate("cells", start, fold, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["block"])))))
    return folded.select("source", F.explode(F.arrays_zip("cells", "made")).alias("z")).select(
        "source", F.col("z.cells.size").alias("size"), F.col("z.cells.docs").alias("docs"), F.col("z.made").alias("copies")
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies, rate, source."""
    release(docs.sparkSession)
    sized = estimated(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size")))
    goals = estimated(targets(sized, weights, share, float(most)))
    histogram = estimated(sized.groupBy("source", "size").agg(F.count("*").alias("docs")))
    tilt = estimated(dual(histogram, goals, float(most)))
    near = lambda left, right: left.join(right.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    rated = near(histogram.filter("size > 0"), tilt.select("source", "lam", "scale")).withColumn("rate", _rate(F.col("lam") * F.col("size") / F.col("scale"), float(most)))
    cells = estimated(_spread(rated.select("source", "size", "docs", (F.col("docs") * F.col("rate")).alias("wish")), most))
    # In a cell, every document gets the whole part; the rest goes to the first by hash.
    cells = cells.select(F.col("source").alias("s"), F.col("size").alias("z"), F.floor(F.col("copies") / F.col("docs")).alias("base"), (F.col("copies") % F.col("docs")).alias("more"), "docs")
    cells = cells.withColumn("salts", F.ceil(F.col("docs") / SALT_ROWS))
    at = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    placed = sized.join(small(estimated(cells), CELLS), at, "left").withColumn("hash", F.xxhash64(F.lit(41), F.col("doc_id"))).withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64(F.lit(43), F.col("doc_id")), F.col("salts"))).otherwise(F.lit(0)))
    # How many of the further copies each salt of a large cell gets: by running counts, so they add up.
    large = placed.filter("salts > 1").groupBy("s", "z", "salt", "more", "docs").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("s", "z").orderBy("salt"))
    upto = lambda n: F.floor(n * F.col("more") / F.col("docs"))
    large = large.select(F.col("s").alias("s2"), F.col("z").alias("z2"), F.col("salt").alias("salt2"), (upto(running) - upto(running - F.col("n"))).alias("here"))
    placed = placed.join(large, F.col("s").eqNullSafe(F.col("s2")) & (F.col("z") == F.col("z2")) & (F.col("salt") == F.col("salt2")) & (F.col("salts") > 1), "left")
    rank = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("hash", "doc_id"))
    copies = F.coalesce(F.col("base") + (rank <= F.coalesce("here", "more")).cast("long"), F.lit(0))
    placed = placed.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long"))
    out = near(near(placed.select("doc_id", "source", "size", "copies"), goals.select("source", "source_size", "target")), tilt.select("source", "lam", "scale"))
    return out.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies",
        F.coalesce(_rate(F.col("lam") * F.col("size") / F.col("scale"), float(most)), F.lit(0.0)).alias("rate"), "source",
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it.

    A document of size 0 costs nothing and stays once. Ids are taken to be unique;
    rows that share one get the largest of their numbers of copies.
    """
    own, times, copy = fresh("id", "times", "copy")
    taken = mix(docs, weights, share, most, id_col, text_col, source_col)
    often = taken.groupBy(F.col("doc_id").alias(own)).agg(F.max(F.when(F.col("size") > 0, F.col("copies")).otherwise(1)).alias(times))
    repeated = docs.join(often.filter(F.col(times) > 0), docs[id_col].eqNullSafe(F.col(own)))
    return repeated.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times).cast("long")))).select(*[repeated[c] for c in docs.columns])


def op4_source_mixing(spark, sf_dir) -> DataFrame:
    return mix(documents(spark, sf_dir)).drop("source")
