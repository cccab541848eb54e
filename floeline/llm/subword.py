"""Bags of hashed subwords, and the linear softmax over their averaged embeddings.

A text is a sequence of words set apart by single marker bytes; its subwords
are the byte n-grams that hold no marker inside (one may open or close them).
Each n-gram is hashed to a row of an embedding table. A bag's logits are its
mean embedding times a softmax layer; both are trained together by stochastic
gradient descent in numpy. As the mean is linear, scoring needs only the
product of table and layer: one gather for each n-gram and sums over segments.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from floeline.llm.flat import is_space, lower_ascii

#: Byte lengths of the subwords.
SIZES = (2, 3, 4)
#: Rows of the embedding table (a power of two) and its width.
BUCKETS = 1 << 17
WIDTH = 12
MARK = 0x20


def letters_only(buf: np.ndarray) -> np.ndarray:
    """Lower-cased ASCII letters and all non-ASCII bytes stay; every other byte becomes a marker."""
    low = lower_ascii(buf)
    low[~(((low >= 97) & (low <= 122)) | (low >= 128))] = MARK
    return low


def all_marks(buf: np.ndarray) -> np.ndarray:
    """Lower-cased bytes; only white space becomes a marker."""
    low = lower_ascii(buf)
    low[is_space(low)] = MARK
    return low


def spaced(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents with a marker before and after each: (bytes, first position of each document, and the end)."""
    n = len(off) - 1
    out = np.full(len(buf) + n + 1 + max(SIZES), MARK, dtype=np.uint8)
    sizes = np.diff(off)
    out[np.arange(len(buf)) + np.repeat(np.arange(n), sizes) + 1] = buf
    return out, off + np.arange(n + 1)


def buckets(text: np.ndarray, size: int, rows: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """For each position the bucket of the n-gram that begins there, and whether it is a subword."""
    n = len(text) - max(SIZES)
    code = np.zeros(n, dtype=np.uint32)
    valid = np.ones(n, dtype=bool)
    for k in range(size):
        code = (code << np.uint32(8)) | text[k : n + k]
        if 0 < k < size - 1:
            valid &= text[k : n + k] != MARK
    if size == 2:  # not two markers
        valid &= (text[:n] != MARK) | (text[1 : n + 1] != MARK)
    code = (code ^ np.uint32(0x9E3779B1 * size & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0xC2B2AE35)
    return ((code >> np.uint32(13)) ^ code) & np.uint32(rows - 1), valid


def segment_sums(table: np.ndarray, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of table rows, numbers of subwords) over the segments that begin at ``starts``.

    A subword belongs to the segment in which it begins.
    """
    n = len(text) - max(SIZES)
    sums = np.zeros((len(starts), table.shape[1]), dtype=np.float64)
    counts = np.zeros(len(starts), dtype=np.float64)
    for size in SIZES:
        at, valid = buckets(text, size, len(table))
        counts += np.add.reduceat(valid[:n].astype(np.int32), starts)
        at[~valid] = 0
        for c in range(table.shape[1]):
            values = table[:, c][at]
            values[~valid] = 0
            sums[:, c] += np.add.reduceat(values, starts, dtype=np.float64)
    return sums, counts


def bags(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, offsets) of the subwords that begin in each span [start, end)."""
    every = [buckets(text, size, rows) for size in SIZES]
    upto = sum(np.concatenate([[0], np.cumsum(valid)]) for _, valid in every)
    n = len(upto) - 1
    off = np.concatenate([[0], np.cumsum(upto[np.minimum(ends, n)] - upto[np.minimum(starts, n)])]).astype(np.int64)
    del upto
    out = np.empty(off[-1], dtype=np.uint32)
    for s, e, i in zip(starts, ends, off[:-1], strict=True):
        for at, valid in every:
            one = at[s:e][valid[s:e]]
            out[i : i + len(one)] = one
            i += len(one)
    return out, off


def softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class BagModel:
    """Embeddings, softmax layer and bias; ``table`` is their product."""

    embeddings: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, classes: int, rng: np.random.Generator, rows: int = BUCKETS, width: int = WIDTH) -> BagModel:
        return cls(rng.normal(0, 0.1, (rows, width)).astype(np.float32), rng.normal(0, 0.3, (width, classes)).astype(np.float32), np.zeros(classes, dtype=np.float32))

    @property
    def table(self) -> np.ndarray:
        return (self.embeddings @ self.layer).astype(np.float32)

    def means(self, at: np.ndarray, off: np.ndarray) -> np.ndarray:
        counts = np.maximum(np.diff(off), 1)
        picked = self.embeddings[at]
        total = np.zeros((len(off) - 1, picked.shape[1]), dtype=np.float32)
        full = np.diff(off) > 0
        if full.any():
            total[full] = np.add.reduceat(picked, off[:-1][full], axis=0)
        return total / counts[:, None]

    def logits(self, at: np.ndarray, off: np.ndarray) -> np.ndarray:
        return self.means(at, off) @ self.layer + self.bias

    def train(self, at: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int, rate: float, rng: np.random.Generator, batch: int = 64) -> None:
        """Stochastic gradient descent on the weighted cross-entropy; embeddings and layer move together.

        The rate falls linearly to zero. Rows of the table move with the number
        of times that the batch holds them.
        """
        n, classes = len(y), self.layer.shape[1]
        steps, step = max(1, epochs * ((n + batch - 1) // batch)), 0
        wanted = np.eye(classes, dtype=np.float32)[y]
        for _ in range(epochs):
            order = rng.permutation(n)
            for i in range(0, n, batch):
                pick = order[i : i + batch]
                lr = rate * (1 - step / steps)
                step += 1
                sizes = off[pick + 1] - off[pick]
                rows = np.repeat(np.arange(len(pick)), sizes)
                inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(off[pick], sizes)
                idx = at[inner]
                mean = self.means(idx, np.concatenate([[0], np.cumsum(sizes)]))
                error = (softmax(mean @ self.layer + self.bias) - wanted[pick]) * weight[pick, None]
                back = error @ self.layer.T / np.maximum(sizes, 1)[:, None]
                step_layer = (mean.T @ error) / len(pick)
                self.layer -= lr * step_layer / max(1.0, float(np.abs(step_layer).max()) * lr)
                self.bias -= lr * error.mean(axis=0)
                unique, place = np.unique(idx, return_inverse=True)
                grad = np.zeros((len(unique), back.shape[1]), dtype=np.float32)
                for c in range(back.shape[1]):
                    grad[:, c] = np.bincount(place, weights=back[rows, c], minlength=len(unique))
                self.embeddings[unique] -= np.clip(lr * grad, -1.0, 1.0).astype(np.float32)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that gives the least cross-entropy on rows that were not trained on."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 120))
    loss = [-np.log(softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
