"""Exact deduplication with counting quotient filters.

Each partition turns its 64-bit text fingerprints into counting quotient
filters (CQF), one for each block of the fingerprint space. Filters of a block
are merged losslessly by their sorted remainders, adding counts. Fingerprints
whose count is above one route their documents to byte verification: those
documents are grouped by the text itself. Everything else is known to be unique
and never moves its text.

Defined cases: null text counts as the empty text; an empty table gives an empty
result; of rows that agree in text *and* id (repeated rows) all carry the same
verdict, and ``keep_documents`` keeps one of them; a null id is smaller than any other, and
rows without id are kept by ``exact_dedup`` where all of their group have none; other columns, of any
name, are not read. Texts may be of any length; only texts that repeat are moved.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floeline.llm.shared import documents, fresh, settled, small, whole

#: Fingerprints that one merged block should hold; bounds the memory of a merge task.
BLOCK_FINGERPRINTS = 500_000
#: Classes (100 bytes each) up to which they are broadcast; beyond, a shuffle join.
BROADCAST_CLASSES = 300_000


class CountingQuotientFilter:
    """Counts of ``bits``-bit fingerprints: a quotient of q bits addresses a run of sorted remainders.

    ``runs[quotient]`` is the length of its run, ``remainders`` holds all runs one
    after another, ``extra`` maps positions to counts where these are above one.
    No bits are dropped, so counts are exact for the fingerprints.
    """

    def __init__(self, bits: int, quotient_bits: int, runs: np.ndarray, remainders: np.ndarray, at: np.ndarray, counts: np.ndarray):
        self.bits, self.quotient_bits, self.runs, self.remainders, self.at, self.counts = bits, quotient_bits, runs, remainders, at, counts

    @classmethod
    def of_items(cls, values: np.ndarray, counts: np.ndarray, bits: int) -> CountingQuotientFilter:
        """From distinct sorted fingerprints and their counts."""
        q = min(bits, max(1, int(len(values) * 4 / 3).bit_length()))
        rest = np.uint64(bits - q)
        quotients = (values >> rest).astype(np.int64) if bits > q else values.astype(np.int64)
        runs = np.bincount(quotients, minlength=1 << q).astype(np.uint32)
        remainders = values & np.uint64((1 << (bits - q)) - 1)
        at = np.flatnonzero(counts > 1)
        return cls(bits, q, runs, remainders, at.astype(np.uint32), counts[at].astype(np.uint64))

    @classmethod
    def of_fingerprints(cls, fingerprints: np.ndarray, bits: int) -> CountingQuotientFilter:
        return cls.of_items(*np.unique(fingerprints, return_counts=True), bits)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct fingerprints, counts)."""
        quotients = np.repeat(np.arange(len(self.runs), dtype=np.uint64), self.runs)
        counts = np.ones(len(self.remainders), dtype=np.uint64)
        counts[self.at] = self.counts
        return (quotients << np.uint64(self.bits - self.quotient_bits)) | self.remainders, counts

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        """Lossless: the sorted sequences are merged and counts of equal fingerprints added."""
        parts = [x.items() for x in (self, *others)]
        values, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(values, kind="stable")  # merges the sorted runs
        values, counts = values[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, dtype=np.int64)
        return self.of_items(values[first], np.add.reduceat(counts, first) if len(first) else counts, self.bits)

    def to_bytes(self) -> bytes:
        width = max(1, (self.bits - self.quotient_bits + 7) // 8)
        packed = np.ascontiguousarray(self.remainders).view(np.uint8).reshape(-1, 8)[:, :width]
        small = self.runs.max(initial=0) < 256
        head = np.array([self.bits, self.quotient_bits, len(self.remainders), len(self.at), small], dtype=np.uint64)
        return b"".join((head.tobytes(), self.runs.astype(np.uint8 if small else np.uint32).tobytes(), packed.tobytes(), self.at.tobytes(), self.counts.tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes) -> CountingQuotientFilter:
        bits, q, n, m, small = map(int, np.frombuffer(data, dtype=np.uint64, count=5))
        at, kind = 40, np.uint8 if small else np.uint32
        runs = np.frombuffer(data, dtype=kind, count=1 << q, offset=at).astype(np.uint32)
        at += (1 << q) * np.dtype(kind).itemsize
        width = max(1, (bits - q + 7) // 8)
        remainders = np.zeros((n, 8), dtype=np.uint8)
        remainders[:, :width] = np.frombuffer(data, dtype=np.uint8, count=n * width, offset=at).reshape(n, width)
        at += n * width
        places = np.frombuffer(data, dtype=np.uint32, count=m, offset=at)
        return cls(bits, q, runs, remainders.reshape(-1).view(np.uint64), places, np.frombuffer(data, dtype=np.uint64, count=m, offset=at + 4 * m))


def repeated_fingerprints(fingerprints: DataFrame, block_bits: int) -> DataFrame:
    """Column ``fp`` (long): the fingerprints that occur more than once in column ``fp``."""
    bits = 64 - block_bits

    def build(batches):
        held = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        values = np.sort(np.concatenate(held)) if held else np.zeros(0, dtype=np.uint64)
        blocks = (values >> np.uint64(bits)).astype(np.int64) if block_bits else np.zeros(len(values), dtype=np.int64)
        edges = np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1], [True]])) if len(values) else [0]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            inner = values[i:j] & np.uint64((1 << bits) - 1)
            yield pa.record_batch([pa.array([int(blocks[i])], pa.int64()), pa.array([CountingQuotientFilter.of_fingerprints(inner, bits).to_bytes()], pa.binary())], names=["block", "cqf"])

    def merge(table: pa.Table) -> pa.Table:
        first, *others = (CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("cqf"))
        values, counts = first.merge(*others).items()
        block = table.column("block")[0].as_py()
        found = values[counts > 1] | np.uint64(block << bits)
        return pa.table({"fp": pa.array(found.view(np.int64), pa.int64())})

    filters = fingerprints.select("fp").mapInArrow(build, "block long, cqf binary")
    return filters.groupBy("block").applyInArrow(merge, "fp long")


def _classes(rows: DataFrame) -> DataFrame:
    """fp, text_sha256, keep_id, group_size of the texts that occur more than once, of rows (doc_id, text, fp)."""
    n = rows.select("doc_id").count()
    block_bits = max(0, math.ceil(math.log2(max(1, n / BLOCK_FINGERPRINTS))))
    repeated = settled(repeated_fingerprints(rows, block_bits))
    # Byte verification: equal only if the texts are; copies collapse before the shuffle.
    groups = rows.join(small(repeated), "fp", "left_semi").groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).filter("group_size > 1")
    return settled(groups.select("fp", _sha("text").alias("text_sha256"), "keep_id", "group_size"))


def _sha(text: Column | str) -> Column:
    return F.sha2((F.col(text) if isinstance(text, str) else text).cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, fp (xxhash64 of the text).

    Of equal texts the row with the largest id stays.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).withColumn("fp", F.xxhash64("text"))
    classes = _classes(rows)
    # A class is one row, so a large group meets it where its rows are read.
    joined = rows.select("doc_id", "fp", _sha("text").alias("text_sha256")).join(small(classes, BROADCAST_CLASSES), ["fp", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", "fp")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without the copies; of fully repeated rows one stays."""
    fp, sha, keep, size = fresh("fp", "sha", "keep", "size")
    text = whole(F.col(text_col))
    classes = _classes(docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).withColumn("fp", F.xxhash64("text")))
    classes = small(classes.toDF(fp, sha, keep, size), BROADCAST_CLASSES)
    met = docs.join(classes, (F.xxhash64(text) == F.col(fp)) & (_sha(text) == F.col(sha)), "left")
    stays = met.filter(F.col(size).isNull() | docs[id_col].eqNullSafe(F.col(keep)))
    # Rows that share the kept id and the text.
    tied = settled(stays.filter(F.col(size).isNotNull()).groupBy(fp, sha).agg(F.count("*").alias(size)).filter(F.col(size) > 1).select(fp, sha))
    if tied.isEmpty():
        return stays.select(*[docs[c] for c in docs.columns])
    stays = stays.select(*[docs[c] for c in docs.columns], F.col(fp), F.col(sha))
    once = stays.join(small(tied), [fp, sha], "left_semi").dropDuplicates([fp, sha])
    alone = stays.join(small(tied.select(F.col(fp).alias(keep), F.col(sha).alias(size))), (F.col(fp) == F.col(keep)) & (F.col(sha) == F.col(size)), "left_anti")
    return alone.unionByName(once.select(*alone.columns)).drop(fp, sha)


def op2_exact_dedup(spark, sf_dir) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("fp")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""
