"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A bag is a segment of a few words; its subwords' embeddings are averaged and go
through a linear softmax. A document's evidence is its most toxic segment, so a
single slur in a long text counts as much as in a short one, and a misspelling
that was never seen shares character n-gram vectors with those that were.
Labels are of documents, so training finds the segments itself: log-odds of
document frequencies propose them, then rounds of joint SGD over embeddings and
layer alternate with choosing each document's most toxic segments anew. The
document's probability is calibrated on rows that were set aside.

Defined cases: null text counts as empty; a text without a subword gets the
lowest evidence seen, never a crash; without labels of both kinds every score is
the share of positive labels (0 without any); an empty table gives an empty
result; a document labelled more than once counts once for each different label in
training; rows that share an id are scored each, and one of them (the least text) is learned from;
equal texts get equal scores; other columns, of any name, are not read. Texts of any length are scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.llm import subword
from floeline.llm.flat import text_slices
from floeline.llm.sample import hashed
from floeline.llm.shared import documents, labels, remainder
from floeline.llm.subword import BagModel, all_marks, bags, buckets, segment_sums, spaced

#: Labelled documents of each class that the model is fitted on, of at most so many bytes.
SAMPLE_PER_CLASS = 1200
SAMPLE_BYTES = 64 << 10
#: Words of a segment.
SEGMENT_WORDS = 3
ROUNDS = 3


def segments(text: np.ndarray, first: np.ndarray, words: int = SEGMENT_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(starts, document) of runs of ``words`` words; each document has at least one.

    A segment begins at the marker before its first word.
    """
    n = int(first[-1])
    body = text[:n]
    begins = np.flatnonzero((body == subword.MARK) & (text[1 : n + 1] != subword.MARK))
    doc = np.searchsorted(first, begins, side="right") - 1
    seen = np.searchsorted(begins, first[:-1], side="left")
    chosen = (np.arange(len(begins)) - seen[doc]) % words == 0
    starts = begins[chosen]
    # Documents begin with a marker; the first segment begins where the document does.
    starts = np.union1d(starts, first[:-1])
    return starts, np.searchsorted(first, starts, side="right") - 1


@dataclass
class ToxicModel:
    table: np.ndarray
    bias: float
    slope: float
    offset: float
    prior: float

    def evidence(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The largest segment logit of each document."""
        text, first = spaced(all_marks(buf), off)
        starts, doc = segments(text, first)
        sums, counts = segment_sums(self.table, text, starts)
        logit = np.where(counts > 0, sums[:, 0] / np.maximum(counts, 1) + self.bias, -30.0)
        return np.maximum.reduceat(logit, np.searchsorted(doc, np.arange(len(off) - 1)))

    def scores(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.slope == 0:
            return np.full(len(off) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.evidence(buf, off) + self.offset, -40, 40)))


def labelled_sample(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int = SAMPLE_PER_CLASS) -> list:
    """Rows (text, y): for each class the documents that come first by a hash of their id."""
    wanted = marks.filter((remainder(id_col, 5) != 0) & F.col(label_col).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    wanted = wanted.withColumn("h", F.xxhash64(F.lit(3), F.col("id")))
    # Twice the bound is drawn, as some documents may be absent or too long.
    few = hashed(wanted, "y", "h", 2 * per_class)
    usable = docs.filter(F.octet_length(text_col) <= SAMPLE_BYTES).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = usable.join(F.broadcast(few), "id").groupBy("id", "y", "h").agg(F.min("text").alias("text"))
    out = []
    for y in (0, 1):
        out += found.filter(F.col("y") == y).orderBy("h", "id").limit(per_class).select("text", "y").collect()
    return out


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a ridged logistic fit, by Newton's method."""
    w, data = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        grad = data.T @ (p - y) + 1e-2 * w
        hess = (data * (p * (1 - p))[:, None]).T @ data + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -5, 5)
    return float(w[0]), float(w[1])


def fit(sample: list, seed: int = 3) -> ToxicModel:
    y = np.array([r["y"] for r in sample], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return ToxicModel(np.zeros((subword.BUCKETS, 1), dtype=np.float32), 0.0, 0.0, 0.0, float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    raw = [r["text"].encode("utf-8", "replace") for r in sample]
    text, first = spaced(all_marks(np.frombuffer(b"".join(raw), dtype=np.uint8)), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    starts, doc = segments(text, first)
    ends = np.concatenate([starts[1:], [first[-1]]])
    aside = rng.random(len(y)) < 0.2
    if len(set(y[~aside].tolist())) < 2 or len(set(y[aside].tolist())) < 2:
        aside = np.zeros(len(y), dtype=bool)
    # Document frequencies of subwords propose the first segments.
    pos, neg = np.zeros(subword.BUCKETS), np.zeros(subword.BUCKETS)
    owner = np.searchsorted(first, np.arange(len(text) - max(subword.SIZES)), side="right") - 1
    for size in subword.SIZES:
        at, valid = buckets(text, size)
        pairs = np.unique(owner[valid].astype(np.int64) * subword.BUCKETS + at[valid])
        of, which = pairs // subword.BUCKETS, pairs % subword.BUCKETS
        ok = of < len(y)
        of, which = of[ok], which[ok]
        ok = ~aside[of]
        pos += np.bincount(which[ok & (y[of] == 1)], minlength=subword.BUCKETS)
        neg += np.bincount(which[ok & (y[of] == 0)], minlength=subword.BUCKETS)
    n1, n0 = (y[~aside] == 1).sum(), (y[~aside] == 0).sum()
    odds = np.log((pos + 1) / (n1 + 2)) - np.log((neg + 1) / (n0 + 2))
    sums, counts = segment_sums(odds[:, None].astype(np.float32), text, starts)
    value = sums[:, 0] / np.maximum(counts, 1)
    model = BagModel.fresh(2, rng)
    trained = ~aside[doc]
    for turn in range(ROUNDS):
        order = np.lexsort((-value, doc))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - np.searchsorted(doc, doc[order])
        toxic = np.flatnonzero(trained & (y[doc] == 1) & (rank < 2))
        clean = np.flatnonzero(trained & (y[doc] == 0) & ((rank < 4) | (rng.random(len(doc)) < min(1.0, 8000 / max(1, len(doc))))))
        # Repeats balance the classes; heavy weights would make the steps unstable.
        pick = np.concatenate([np.repeat(toxic, max(1, len(clean) // max(1, len(toxic)))), clean])
        at, off = bags(text, starts[pick], ends[pick])
        model.train(at, off, y[doc[pick]], np.ones(len(pick), dtype=np.float32), epochs=3, rate=4.0, rng=rng)
        table = model.table
        sums, counts = segment_sums((table[:, 1] - table[:, 0])[:, None].astype(np.float32), text, starts)
        value = sums[:, 0] / np.maximum(counts, 1)
    bias = float(model.bias[1] - model.bias[0])
    table = (model.table[:, 1] - model.table[:, 0])[:, None].astype(np.float32)
    best = np.maximum.reduceat(np.where(counts > 0, value + bias, -30.0), np.searchsorted(doc, np.arange(len(y))))
    held = aside if aside.any() else ~aside
    # The sample is balanced; so is the calibration, which puts 0.5 between the classes.
    slope, offset = _logistic(np.clip(best[held], -30, 30), y[held])
    return ToxicModel(table, bias, slope, offset, float(y.mean()))


def score_documents(docs: DataFrame, model, id_col: str, text_col: str, cut: float) -> DataFrame:
    """doc_id, held_out, score, predicted; ``model.scores`` sees whole texts only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def predict(batches):
        m = shared.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for i, j, buf, off in text_slices(batch.column(2), 1 << 19):
                score[i:j] = m.scores(buf, off)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32), pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, 5) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", model: ToxicModel | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from a score of 0.5)."""
    return score_documents(docs, model or fit(labelled_sample(docs, marks, id_col, text_col, label_col)), id_col, text_col, 0.5)


def op3_toxicity(spark, sf_dir) -> DataFrame:
    return toxicity(documents(spark, sf_dir), labels(spark, sf_dir))
