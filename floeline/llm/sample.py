"""Bounded samples by hash: no sorting, no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hashed(rows: DataFrame, group: str, h: str, size: int) -> DataFrame:
    """The rows (with a column of a hash) whose hash is below a bound that leaves at least about ``size`` of each group.

    Bounds come from the groups' counts, so each row is judged where it is read. The mean is ``size`` and
    five standard deviations; rows of equal hash go together. Who needs ``size`` exactly takes the smallest hashes.
    """
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    share = F.lit(size + 5 * size**0.5 + 10) / F.col("n")
    bounds = counts.select(F.col(group).alias("of"), F.least(share, F.lit(1.0)).alias("share"))
    # As a fraction, a hash of 64 bits is even over 0 to 1.
    fraction = F.col(h).cast("double") / F.lit(2.0**64) + F.lit(0.5)
    return rows.join(F.broadcast(bounds), F.col(group) == F.col("of")).filter(fraction <= F.col("share")).drop("of", "share")
