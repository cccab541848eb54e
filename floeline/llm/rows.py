"""Identity of rows: each distinct (id, text) is a document, also where ids are null or shared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floeline.llm.shared import settled, small, whole, written

#: Numbered documents up to which their (id, digest, number) are broadcast (50 bytes each).
BROADCAST_NAMES = 500_000


def digest(text: Column | str) -> Column:
    return F.unhex(F.sha2((F.col(text) if isinstance(text, str) else text).cast("binary"), 256))


def numbered(keys: DataFrame, order: list[Column]) -> DataFrame:
    """The rows with gapless numbers from 0 in the given order; only one count of each task goes to the driver."""
    ranged = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = settled(ranged.withColumn("part", F.shiftright("place", 33)).withColumn("place", F.col("place") % F.lit(1 << 33)))
    sizes = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}
    offsets, total = [], 0
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    offsets = keys.sparkSession.createDataFrame(offsets, "part long, offset long")
    return ranged.join(F.broadcast(offsets), "part").withColumn("number", F.col("offset") + F.col("place")).drop("part", "place", "offset")


def keyed(rows: DataFrame) -> DataFrame:
    """(id, sha, n_bytes) of rows (id, text), written once; all that is asked of identities is read from here."""
    return written(rows.select("id", digest("text").alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "text-keys")


def identified(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(rows, keys, names) with an id of its own for each distinct (id, text); rows (id, text) have no null texts, ``keys`` are theirs.

    Where no id is null and none is shared by different texts, ids stay and ``names`` is None. Else
    documents are numbered in order of id (null first), then of their texts' digests, and ``names`` has
    the rows (number, id, sha); texts then move once unless names are few enough to be broadcast.
    """
    odd = keys.groupBy("id").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi")).filter("id IS NULL OR lo != hi")
    if odd.isEmpty():
        return rows, keys, None
    names = settled(numbered(keys.select("id", "sha").distinct(), [F.col("id").asc_nulls_first(), F.col("sha").asc()]))
    right = small(names.select(F.col("id").alias("own"), F.col("sha").alias("of"), "number"), BROADCAST_NAMES)
    mine = F.col("id").eqNullSafe(F.col("own"))
    named = rows.join(right, mine & (digest("text") == F.col("of"))).select(F.col("number").alias("id"), "text")
    return named, settled(keys.join(right, mine & (F.col("sha") == F.col("of"))).select(F.col("number").alias("id"), "sha", "n_bytes")), names


def of_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of all rows, null texts as empty ones."""
    return docs.select(F.col(id_col).cast("long").alias("id"), whole(F.col(text_col).cast("string")).alias("text"))
