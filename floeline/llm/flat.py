"""Flat byte views of Arrow text columns and vectorised word work on them.

Every operator that needs Python reads Arrow batches (``mapInArrow``), looks at
the batch's UTF-8 buffer as one ``uint8`` array plus document offsets, and works
with numpy on slices of a few megabytes. Memory per task is therefore bounded
by the slice size (or by one document, if that is longer), not by the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that one vectorised step looks at (a longer document is a step of its own).
SLICE_BYTES = 2 << 20
#: Multiplier of the rolling byte hash; odd, so it has an inverse modulo 2**64.
_P = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_P_INV = pow(_P, -1, 1 << 64)

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (murmur style); vectorised, wraps modulo 2**64."""
    x = x ^ np.uint64((seed * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) & _MASK)
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x ^= x >> np.uint64(33)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


#: A random 64-bit value for each byte, made by rule.
BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64), 7)


def _grow(n: int) -> None:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 2 * len(_powers), SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _P, dtype=np.uint64))]).astype(np.uint64)
            _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, _P_INV, dtype=np.uint64))]).astype(np.uint64)


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """H with H[i] = sum of code(b_j) * P**j over j < i, modulo 2**64; length len(buf) + 1."""
    _grow(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.take(BYTE_CODE, buf, out=out[1:], mode="clip")
    out[1:] *= _powers[: len(buf)]
    np.cumsum(out[1:], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans; equal spans have equal hashes wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * _inverses[starts] + (ends - starts).astype(np.uint64), seed)


def rolling_hash(prefix: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """``span_hash`` of every span of ``width`` bytes, by place."""
    out = prefix[width:] - prefix[:-width]
    out *= _inverses[: len(out)]
    out += np.uint64(width)
    return mix(out, seed)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    if len(off) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    return buf[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """Ranges (i, j) of documents of at most ``most`` bytes together, or of one longer document."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def is_space(buf: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09-0x0D; every other byte belongs to a word."""
    return (buf == 0x20) | ((buf >= 0x09) & (buf <= 0x0D))


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, document) of the maximal runs of bytes that are not space; runs end with their document."""
    if not len(buf):
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    inner = ~is_space(buf)
    first = np.zeros(len(buf) + 1, dtype=bool)
    first[off] = True
    starts = np.flatnonzero(inner & (np.concatenate([[True], ~inner[:-1]]) | first[:-1]))
    ends = np.flatnonzero(inner & (np.concatenate([~inner[1:], [True]]) | first[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    return out


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """(first document, last + 1, bytes, offsets) for each slice of a column."""
    buf, off = flat(column)
    for i, j in slices(off, most):
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
