"""Quality: random-indexing word vectors pooled per document, then a two-layer numpy network.

Every word has a sparse random index vector, made from its hash by rule. Its
word vector is the sum of the index vectors of its neighbours over the whole
corpus (all documents count; labels play no part), normalised, plus its own
index vector. Words are hashed to a fixed number of rows, so the vectors are a
table of fixed size, which tasks sum up in blocks and a two-level tree adds.
A document is the mean of its words' vectors. The words of a text are its runs
of letters, digits and other signs, and for each space-separated unit a word
that names its form (case, signs, repetition of the unit before it). A network
of two layers is trained on labelled documents' pooled vectors, and the
temperature of its logit is calibrated on rows that were set aside.

Defined cases: null text counts as empty and pools to the zero vector; without
labels of both kinds every score is the share of positive labels (1 without
any); rows that share an id are scored each, and one of them is learned from (the least pooled vector in
bytes); a document labelled more than once counts once for each different label; equal texts get equal scores;
an empty table gives an empty result; other columns, of any name, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.llm.flat import is_space, lower_ascii, mix, prefix_hash, span_hash, text_slices, words
from floeline.llm.shared import documents, labels, remainder
from floeline.llm.toxicity import score_documents

#: Rows of the word table, width of the vectors, and non-zero entries of an index vector.
ROWS = 1 << 15
DIMS = 64
NONZERO = 4
#: Blocks in which the table is summed.
BLOCKS = 16
#: Labelled documents that the network is fitted on.
SAMPLE = 6000
HIDDEN = 24
SLICE = 1 << 19
#: Words whose neighbours are gathered before they are added to the table, and that one step of pooling takes.
FLUSH, PIECE = 1 << 20, 1 << 16


def index_entries() -> tuple[np.ndarray, np.ndarray]:
    """(columns, signs) of the non-zero entries of every row's index vector, by rule: ROWS x NONZERO each."""
    rows = np.arange(ROWS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        h = np.stack([mix(rows, 100 + k) for k in range(NONZERO)], axis=1)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def index_vectors() -> np.ndarray:
    """The sparse ternary index vector of every row."""
    out = np.zeros((ROWS, DIMS), dtype=np.float32)
    columns, signs = index_entries()
    for k in range(NONZERO):
        np.add.at(out, (np.arange(ROWS), columns[:, k]), signs[:, k])
    return out


def tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(table row and place of each word, table row and place of each unit's form), both in order of their places."""
    if not len(buf):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    with np.errstate(over="ignore"):
        low = lower_ascii(buf)
        letter = ((low >= 97) & (low <= 122)) | (low >= 128)
        digit = (buf >= 48) & (buf <= 57)
        upper = (buf >= 65) & (buf <= 90)
        space = is_space(buf)
        kind = np.where(space, 0, np.where(letter, 1, np.where(digit, 2, 3))).astype(np.int8)
        begin = np.empty(len(buf), dtype=bool)
        begin[0] = True
        np.not_equal(kind[1:], kind[:-1], out=begin[1:])
        begin[off[:-1][off[:-1] < len(buf)]] = True
        begin = np.flatnonzero(begin)
        inner = ~space[begin]
        starts, ends = begin[inner], np.append(begin[1:], len(buf))[inner]
        prefix = prefix_hash(low)
        row = (span_hash(prefix, starts, ends, 1) % np.uint64(ROWS)).astype(np.int64)
        # One word for the form of each unit between spaces.
        s, e, _ = words(buf, off)
        counts = [np.cumsum(x, dtype=np.int32) for x in (upper, letter, digit, kind == 3)]
        up, let, dig, sign = (x[e - 1] - np.where(s, x[s - 1], 0) for x in counts)
        case = np.where(up == 0, 0, np.where(up == let, 1 + (let > 1), np.where((up == 1) & upper[s], 3, 4)))
        unit = span_hash(prefix, s, e, 2)
        same = np.concatenate([[False], (unit[1:] == unit[:-1]) & (s[1:] > s[:-1])])[: len(s)]
        form = ((case * 4 + np.minimum(sign, 3)) * 2 + (dig > 0)) * 2 + same
        # There are few forms, so each is hashed once.
        form = (mix(np.arange(80, dtype=np.uint64), 3) % np.uint64(ROWS)).astype(np.int64)[form]
    return row, starts, form, s


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The normalised word table of the whole corpus: ROWS x DIMS, of fixed size; counts are whole numbers and exact."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    per_task = ROWS // BLOCKS
    salts = max(1, math.isqrt(texts.rdd.getNumPartitions()))

    def count(batches):
        from pyspark import TaskContext

        columns, signs = index_entries()
        table = np.zeros(ROWS * DIMS)
        held, size = [], 0

        def add() -> None:
            left, right = (np.concatenate([x[k] for x in held]) for k in range(2))
            for place, near in ((left, right), (right, left)):
                for k in range(NONZERO):
                    table[:] += np.bincount(place * DIMS + columns[near, k], weights=signs[near, k], minlength=ROWS * DIMS)

        for batch in batches:
            for _, _, buf, off in text_slices(batch.column(0), SLICE):
                row, starts, form, s = tokens(buf, off)
                at = np.concatenate([starts, s])
                order = np.argsort(at, kind="stable")  # merges two sorted runs
                row = np.concatenate([row, form])[order]
                # Neighbours: the words right before and after, in the same document.
                last = np.searchsorted(at[order], off[1:-1])
                apart = np.ones(max(0, len(row) - 1), dtype=bool)
                apart[last[(last > 0) & (last < len(row))] - 1] = False
                held.append((row[:-1][apart], row[1:][apart]))
                size += len(row)
                if size >= FLUSH:
                    add()
                    held, size = [], 0
        if held:
            add()
        salt = TaskContext.get().partitionId() % salts
        blocks = [_packed(table[b * per_task * DIMS : (b + 1) * per_task * DIMS]) for b in range(BLOCKS)]
        yield pa.record_batch([pa.array(range(BLOCKS), pa.int32()), pa.array([salt] * BLOCKS, pa.int32()), pa.array(blocks, pa.binary())], names=["block", "salt", "sums"])

    def add_up(table: pa.Table) -> pa.Table:
        total = np.zeros(per_task * DIMS)
        for chunk in table.column("sums"):
            total += _unpacked(chunk.as_buffer(), per_task)
        return pa.table({"block": table.column("block").slice(0, 1), "salt": table.column("salt").slice(0, 1), "sums": pa.array([_packed(total)], pa.binary())})

    schema = "block int, salt int, sums binary"
    summed = texts.mapInArrow(count, schema).groupBy("block", "salt").applyInArrow(add_up, schema).groupBy("block").applyInArrow(add_up, schema)
    out = np.zeros((ROWS, DIMS))
    for r in summed.collect():  # BLOCKS rows of fixed size
        out[r["block"] * per_task : (r["block"] + 1) * per_task] = _unpacked(r["sums"], per_task).reshape(-1, DIMS)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    index = index_vectors()
    return (0.5 * out + index / np.maximum(np.linalg.norm(index, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _packed(sums: np.ndarray) -> bytes:
    return pa.compress(sums.astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data, rows: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, decompressed_size=rows * DIMS * 8, codec="zstd", asbytes=True), dtype=np.int64).astype(np.float64)


def pooled(vectors: np.ndarray, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The mean word vector of each document (zeros without a word); long documents are summed piece by piece."""
    n = len(off) - 1
    row, starts, form, s = tokens(buf, off)
    total, counts = np.zeros((n, vectors.shape[1])), np.zeros(n)
    for rows, at in ((row, starts), (form, s)):
        edges = np.searchsorted(at, off)
        counts += np.diff(edges)
        for a in range(0, len(rows), PIECE):
            stop = min(len(rows), a + PIECE)
            i, j = np.searchsorted(edges, a, side="right") - 1, np.searchsorted(edges, stop, side="left")
            full = np.flatnonzero(np.diff(np.clip(edges[i : j + 1], a, stop)))
            total[i + full] += np.add.reduceat(vectors[rows[a:stop]], np.maximum(edges[i + full] - a, 0), axis=0)
    return total / np.maximum(counts, 1)[:, None]


class QualityModel:
    """Pooled vector, standardised, then tanh layer and logistic output over a temperature."""

    def __init__(self, vectors: np.ndarray, prior: float):
        self.vectors, self.prior, self.net = vectors, prior, None
        self.mean, self.scale, self.temperature = np.zeros(DIMS), np.ones(DIMS), 1.0
        self.hidden = self.offset = None

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.net
        return (np.tanh(((x - self.mean) / self.scale) @ w1 + b1) @ w2 + b2)[:, 0]

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(off) - 1, self.prior)
        # The first layer is linear in the mean vector, so words carry its HIDDEN sums instead of their vectors.
        _, _, w2, b2 = self.net
        logit = (np.tanh(pooled(self.hidden, buf, off) + self.offset) @ w2 + b2)[:, 0]
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 9, epochs: int = 60, rate: float = 3e-3) -> None:
        """Adam on the cross-entropy with weight decay; a fifth of the rows sets the temperature."""
        rng = np.random.default_rng(seed)
        aside = rng.random(len(y)) < 0.2
        if len(set(y[~aside].tolist())) < 2:
            aside[:] = False
        self.mean, self.scale = x[~aside].mean(axis=0), x[~aside].std(axis=0) + 1e-6
        z = (x[~aside] - self.mean) / self.scale
        t = y[~aside].astype(np.float64)[:, None]
        net = [rng.normal(0, 1 / np.sqrt(DIMS), (DIMS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), np.zeros(1)]
        first, second, step = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net], 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for i in range(0, len(z), 64):
                a, b = z[order[i : i + 64]], t[order[i : i + 64]]
                hidden = np.tanh(a @ net[0] + net[1])
                error = (1 / (1 + np.exp(-np.clip(hidden @ net[2] + net[3], -40, 40))) - b) / len(a)
                back = (error @ net[2].T) * (1 - hidden**2)
                grads = [a.T @ back + 1e-4 * net[0], back.sum(axis=0), hidden.T @ error + 1e-4 * net[2], error.sum(axis=0)]
                step += 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    net[k] = net[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.net = net
        self.hidden = (self.vectors @ (net[0] / self.scale[:, None])).astype(np.float32)
        self.offset = net[1] - (self.mean / self.scale) @ net[0]
        held = aside if aside.any() else ~aside
        logit, truth = self.logits(x[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.2), np.log(20), 120))
        loss = [np.logaddexp(0, np.where(truth == 1, -logit, logit) / g).mean() for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])


def fit(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, label_col: str) -> QualityModel:
    spark = docs.sparkSession
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text_col))
    wanted = marks.filter((remainder(id_col, 5) != 0) & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    wanted = wanted.orderBy(F.xxhash64(F.lit(9), F.col("id")), "id", "y").limit(SAMPLE)

    def features(batches):
        for batch in batches:
            for i, j, buf, off in text_slices(batch.column(2), SLICE):
                x = pooled(vectors.value, buf, off).astype(np.float32)
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "y", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(wanted), "id").select("id", "y", "text")
    found = rows.mapInArrow(features, "id long, y int, x binary").groupBy("id", "y").agg(F.min("x").alias("x"))
    got = found.collect()  # at most SAMPLE rows of DIMS numbers
    got.sort(key=lambda r: (r["y"], r["x"]))
    y = np.array([r["y"] for r in got], dtype=np.int64)
    model = QualityModel(vectors.value, float(y.mean()) if len(y) else 1.0)
    if len(set(y.tolist())) == 2:
        model.fit(np.array([np.frombuffer(r["x"], dtype=np.float32) for r in got]).astype(np.float64), y)
    return model


def quality(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of ``cut``)."""
    return score_documents(docs, fit(docs, marks, id_col, text_col, label_col), id_col, text_col, cut)


def op9_quality(spark, sf_dir) -> DataFrame:
    return quality(documents(spark, sf_dir), labels(spark, sf_dir))
