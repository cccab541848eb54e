"""Media columns: content-addressed payloads in tar shards, rows that point into them.

``pack`` writes each partition's payloads as members of tar shards in a shared
folder. A member is an 8-bit greyscale PNG (lossless) named by the SHA-256 of
its bytes; equal contents of a partition are stored once. The manifest rows
carry digest, shard, offset and length. ``media_columns`` fills metadata columns
by range reads of the 33 header bytes alone; ``read_payloads`` reads whole
members back. Shards are reached through ``pyarrow.fs``, so any store that it
knows will do.

A retried task writes shards under a new name, and only the attempt whose rows
were committed with the manifest is ever pointed at; a lost executor costs a
re-run of its tasks and at most some unreferenced files.

Defined cases: null text is the empty text, whose payload is one row of 255s;
an empty table gives an empty manifest; repeated rows and equal texts point at
equal contents; other columns are not read. Memory: one document and its
encodings at a time, and about 150 bytes for each distinct content of a task.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.llm.flat import flat
from floeline.llm.shared import documents, shared_dir, written

#: Samples in a picture's row; payloads are padded to a positive multiple.
WIDTH = 576
#: Bytes after which a task begins another shard.
SHARD_BYTES = 512 << 20
#: PNG's signature, and where its IHDR chunk ends. Fixed values.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PNG_HEADER_BYTES = 33


def payload_of(text: bytes) -> bytes:
    """The text's bytes, then 255s up to a positive multiple of WIDTH."""
    return text + b"\xff" * (-len(text) % WIDTH if text else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit greyscale PNG of WIDTH columns, every row unfiltered."""
    rows = np.frombuffer(payload, dtype=np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> tuple[int, int, int]:
    """(width, height, bits) from the first 33 bytes."""
    if data[:8] != PNG_SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", data[16:25])


def decode_png(data: bytes) -> bytes:
    """The samples of a PNG that ``encode_png`` made; checks chunk sums and row filters."""
    width, height, bits = png_header(data[:PNG_HEADER_BYTES])
    at, packed = 8, []
    while at < len(data):
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError("a chunk is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(height, width + 1)
    if bits != 8 or lines[:, 0].any():
        raise ValueError("unexpected sample format")
    return lines[:, 1:].tobytes()


class ShardWriter:
    """Tar shards of one task; ``put`` returns where a content lies."""

    def __init__(self, folder: str, most: int = SHARD_BYTES):
        self.folder, self.most, self.tar, self.out, self.name, self.seen = folder, most, None, None, "", {}

    def put(self, key: bytes, make) -> tuple[str, str, int, int]:
        if key not in self.seen:
            data = make()
            if self.tar is None or self.tar.offset > self.most:
                self._next()
            digest = hashlib.sha256(data).hexdigest()
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(data)
            self.tar.addfile(info, io.BytesIO(data))
            at = self.tar.offset - (len(data) + 511) // 512 * 512
            self.seen[key] = (digest, self.name, at, len(data))
        return self.seen[key]

    def _next(self) -> None:
        from pyarrow.fs import FileSystem

        self.close()
        store, path = FileSystem.from_uri(self.folder)
        store.create_dir(path, recursive=True)
        self.name = f"shard-{uuid.uuid4().hex}.tar"
        self.out = store.open_output_stream(f"{path}/{self.name}")
        self.tar = tarfile.open(fileobj=self.out, mode="w|", format=tarfile.USTAR_FORMAT)

    def close(self) -> None:
        if self.tar is not None:
            self.tar.close()
            self.out.close()
            self.tar = None


MANIFEST = "doc_id long, n_bytes long, digest string, shard string, at long, length long"


def pack(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", level: int = 6) -> DataFrame:
    """The manifest of all documents' payloads; written, so that shards are made once."""

    def store(batches):
        writer = ShardWriter(folder)
        for batch in batches:
            buf, off = flat(batch.column(1))
            rows = []
            for i in range(batch.num_rows):
                text = buf[off[i] : off[i + 1]].tobytes()
                where = writer.put(hashlib.sha256(text).digest(), lambda text=text: encode_png(payload_of(text), level))
                rows.append((len(text), *where))
            n, digest, shard, at, length = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(shard, pa.string()), pa.array(at, pa.int64()), pa.array(length, pa.int64())], names=["doc_id", "n_bytes", "digest", "shard", "at", "length"])
        writer.close()

    return written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(store, MANIFEST), "manifest")


class ShardReader:
    """Range reads; keeps the last shard open, as neighbouring rows point into the same one."""

    def __init__(self, folder: str):
        from pyarrow.fs import FileSystem

        self.store, self.path = FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def read(self, shard: str, at: int, length: int) -> bytes:
        if shard != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = shard, self.store.open_input_file(f"{self.path}/{shard}")
        return self.file.read_at(length, at)


def media_columns(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest with width, height and bits, read from the headers alone."""

    def fill(batches):
        reader = ShardReader(folder)
        for batch in batches:
            heads = [png_header(reader.read(s, a, PNG_HEADER_BYTES)) for s, a in zip(batch.column("shard").to_pylist(), batch.column("at").to_pylist(), strict=True)]
            columns = [pa.array([h[k] for h in heads], pa.int64()) for k in range(3)]
            yield pa.record_batch([*batch.columns, *columns], names=[*batch.schema.names, "width", "height", "bits"])

    return manifest.mapInArrow(fill, f"{MANIFEST}, width long, height long, bits long")


def feature_of(samples: bytes, width: int, height: int, bits: int) -> str:
    """Format and statistics of the samples: mean, deviation, distinct values, mean step along a row."""
    x = np.frombuffer(samples, dtype=np.uint8)
    counts = np.bincount(x, minlength=256)
    mean = float(counts @ np.arange(256)) / len(x)
    deviation = float(np.sqrt(counts @ (np.arange(256) - mean) ** 2 / len(x)))
    grid = x.reshape(height, width).astype(np.int16)
    step = float(np.abs(np.diff(grid, axis=1)).sum(dtype=np.int64)) / (height * (width - 1))
    return f"png:{width}x{height}x{bits};mean={mean:.3f};dev={deviation:.3f};values={int((counts > 0).sum())};step={step:.3f}"


def read_payloads(described: DataFrame, folder: str) -> DataFrame:
    """Reads every member whole: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, and the pointer columns."""

    def load(batches):
        reader = ShardReader(folder)
        for batch in batches:
            rows, last = [], (None, None)
            for r in batch.to_pylist():
                if last[0] != (key := (r["shard"], r["at"])):
                    data = reader.read(r["shard"], r["at"], r["length"])
                    digest = hashlib.sha256(data).hexdigest()
                    if digest != r["digest"]:
                        raise ValueError(f"{r['shard']} at {r['at']}: the content does not have its address")
                    samples = decode_png(data)
                    last = key, (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(data), digest, feature_of(samples, r["width"], r["height"], r["bits"]))
                rows.append(last[1])
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            got = [pa.array([row[k] for row in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("n_bytes"), *got, *(batch.column(c) for c in ("shard", "at", "width", "height"))],
                names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "at", "width", "height"],
            )

    return described.mapInArrow(load, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, at long, width long, height long")


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    folder = f"{shared_dir(docs.sparkSession).rstrip('/')}/media-{uuid.uuid4().hex}"
    return read_payloads(media_columns(pack(docs, folder, id_col, text_col), folder), folder)


def op8_media_columns(spark, sf_dir) -> DataFrame:
    return media(documents(spark, sf_dir)).drop("shard", "at")
