"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

The model is fitted on the driver from a bounded sample of labelled rows, then
applied to whole texts in vectorised Arrow batches. A fifth of the sample is set
aside to calibrate: the temperature of the softmax, and the confidence below
which a prediction is rejected, the lower ``REJECT_SHARE`` quantile of the
confidence on that part, at most ``REJECT_MOST``.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and
is rejected; without any labelled row every text is ``und``; an empty table
gives an empty result; ties go to the first language by code point; repeated rows and rows that
share an id are predicted each, and one of them is learned from; a document of any length is read
whole when it is predicted, and learned from in pieces spread over all of it; other columns, of any
name, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.llm.flat import text_slices
from floeline.llm.sample import hashed
from floeline.llm.shared import documents, release, remainder
from floeline.llm.subword import WIDTH, BagModel, bags, letters_only, segment_sums, softmax, spaced, temperature

#: Labelled documents for each language that the model is fitted on; every language is learned.
SAMPLE_PER_LANGUAGE = 500
#: Characters of a piece that is trained on, and pieces up to which a document comes whole.
EXCERPT, PIECES = 240, 32
EPOCHS = 3
REJECT_SHARE = 0.002
REJECT_MOST = 0.5
UNKNOWN = "und"


@dataclass
class LanguageModel:
    """``table`` holds the logits of each subword or, with more languages than WIDTH, its embedding, which ``layer`` maps."""

    names: list[str]
    table: np.ndarray
    layer: np.ndarray | None
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sums, counts = segment_sums(self.table, text, starts)
        mean = sums / np.maximum(counts, 1)[:, None]
        return (mean if self.layer is None else mean @ self.layer) + self.bias

    def probabilities(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """One row of class probabilities for each document."""
        text, first = spaced(letters_only(buf), off)
        return softmax(self.logits(text, first[:-1]) / self.temperature)


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list:
    """Rows (lang, h, pieces): of every language the documents of the smallest hashes, in pieces of EXCERPT characters.

    Documents of up to PIECES pieces come whole, of longer ones so many pieces, spread evenly over the whole text.
    """
    usable = docs.filter((remainder(id_col, 5) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = usable.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(5), F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("text"))
    # The bound comes from ids only; texts are read where a row is chosen. Rows that share an id are one.
    few = hashed(rows, "lang", "h", SAMPLE_PER_LANGUAGE)
    count = F.greatest(F.ceil(F.char_length("text") / F.lit(float(EXCERPT))).cast("int"), F.lit(1))
    taken = F.least(count, F.lit(PIECES))
    pieces = F.transform(F.sequence(F.lit(0), taken - 1), lambda k: F.col("text").substr(F.floor(k.cast("long") * count / taken).cast("int") * EXCERPT + 1, F.lit(EXCERPT)))
    got = few.select("lang", "h", pieces.alias("pieces")).groupBy("lang", "h").agg(F.min("pieces").alias("pieces")).collect()
    out, held = [], {}
    for r in sorted(got, key=lambda r: (r["lang"], r["h"])):
        held[r["lang"]] = held.get(r["lang"], 0) + 1
        if held[r["lang"]] <= SAMPLE_PER_LANGUAGE:
            out.append(r)
    return out


def fit(sample: list, seed: int = 5) -> LanguageModel | None:
    names = sorted({r["lang"] for r in sample})
    if not names:
        return None
    rng = np.random.default_rng(seed)
    number = {name: k for k, name in enumerate(names)}
    y = np.array([number[r["lang"]] for r in sample])
    aside = rng.random(len(sample)) < 0.2
    # A language whose documents were all set aside would not be learned.
    for k in range(len(names)):
        if aside[y == k].all():
            aside[np.flatnonzero(y == k)] = False
    raw = [x.encode("utf-8", "replace") for r in sample for x in r["pieces"]]
    text, first = spaced(letters_only(np.frombuffer(b"".join(raw), dtype=np.uint8)), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64))
    owner = np.repeat(np.arange(len(sample)), [len(r["pieces"]) for r in sample])
    train = np.flatnonzero(~aside[owner])
    model = BagModel.fresh(len(names), rng)
    at, off = bags(text, first[train], first[train + 1])
    labels = y[owner[train]]
    share = np.bincount(labels, minlength=len(names)) / len(labels)
    # A document's pieces weigh as one document of about three.
    own = 3 / np.bincount(owner)[owner[train]]
    weight = (1 / np.maximum(share, 1e-9) / len(names))[labels] * np.minimum(own, 1)
    model.train(at, off, labels, weight.astype(np.float32), epochs=EPOCHS, rate=6.0, rng=rng)
    many = len(names) > WIDTH
    made = LanguageModel(names, model.embeddings if many else model.table, model.layer if many else None, model.bias, 1.0, 0.0)
    logits = made.logits(text, first[np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])])
    made.temperature = temperature(logits[aside], y[aside])
    sure = softmax(logits[aside] / made.temperature).max(axis=1)
    made.reject_below = min(REJECT_MOST, float(np.quantile(sure, REJECT_SHARE))) if len(sure) else 0.0
    return made


def has_letter(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether a document holds a letter of any script."""
    ascii_letter = ((buf >= 65) & (buf <= 90)) | ((buf >= 97) & (buf <= 122))
    seen = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = seen[off[1:]] > seen[off[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(ch.isalpha() for ch in buf[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
    return found


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: LanguageModel | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""
    model = model or fit(labelled_sample(docs, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def predict(batches):
        m = shared.value
        names = np.array([UNKNOWN, *(m.names if m else [])], dtype=object)
        for batch in batches:
            n = batch.num_rows
            best, score = np.zeros(n, dtype=np.int64), np.zeros(n)
            for i, j, buf, off in text_slices(batch.column(2)) if m else ():
                p = m.probabilities(buf, off)
                known = has_letter(buf, off)
                best[i:j] = np.where(known, p.argmax(axis=1) + 1, 0)
                score[i:j] = np.where(known, p.max(axis=1), 0.0)
            rejected = (best == 0) | (score < (m.reject_below if m else 0))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col, 5) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is accepted; one pass, no join."""
    model = fit(labelled_sample(docs, id_col, text_col, lang_col))
    release(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def select(batches):
        m = shared.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i, j, buf, off in text_slices(batch.column(place)) if m else ():
                keep[i:j] = has_letter(buf, off) & (m.probabilities(buf, off).max(axis=1) >= m.reject_below)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(select, docs.schema)


def op5_language_id(spark, sf_dir) -> DataFrame:
    return identify(documents(spark, sf_dir))
