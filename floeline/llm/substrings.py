"""Removal of repeated passages: a depth-limited radix sort of suffixes.

Suffixes are ordered only through ``DEPTH`` bytes, by most-significant-digit
passes of eight bytes each; after a pass, a suffix that stands alone is settled
and leaves. The groups that remain after the last pass are exactly the repeated
windows of DEPTH bytes. Of each group all but the earliest (by document, then
place) are removed from the texts.

Sorting every suffix of a corpus would move it many times over. Two exact
reductions come first. Equal texts: all but the first are repeats as a whole.
Anchors: a window's anchor is its smallest hashed 32-byte string (the leftmost of
equals), so equal windows have equal anchors at equal places, and windows whose
anchor string occurs once need no sorting. Anchors are about 1 in 35 places; they
are counted in packed blocks dealt by hash. Only documents that hold a repeated
anchor send windows, as runs of bytes, to the anchor's bucket, and a slice of
documents first sorts its own windows, so a passage that is common travels once
from each slice. The windows of very frequent anchors are dealt by a hash of the
whole window, so that a passage that a third of all documents hold is spread.

Defined cases: null text counts as empty; texts under DEPTH bytes lose nothing;
repeated rows (same id and text) share one verdict; rows that share an id, or have none, with
different texts are documents of their own, in the order of their texts' digests, and those without id come
before all others; texts may be as long as Arrow allows (2 GiB); an empty table gives an empty
result; other columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.llm.flat import flat, mix, prefix_hash, rolling_hash, span_hash, text_slices
from floeline.llm.rows import identified, keyed, of_texts
from floeline.llm.shared import BROADCAST_ROWS, documents, settled, small

DEPTH = 100
#: Bytes of an anchor string.
ANCHOR = 32
#: Occurrences from which an anchor's windows are dealt by their whole content.
FREQUENT = 20_000
#: Bytes of packed anchors that one bucket should hold.
BUCKET_BYTES = 4 << 20
SLICE = 1 << 20
#: Bits of a place in a slice, as many as a text can be long; the hash's other bits choose the anchor.
_PLACE = np.uint64((1 << 31) - 1)
#: Groups of equal texts (50 bytes each) up to which they are broadcast.
GROUPS = 500_000


def radix_classes(buf: np.ndarray, at: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """A class number for each window buf[at : at + depth]; -1 for windows that occur once.

    Most significant digits first, eight bytes a pass (the last pass reaches back where
    depth is not a multiple of eight); only windows that still have an equal go on.
    """
    out = np.full(len(at), -1, dtype=np.int64)
    if len(at) < 2:
        return out
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    digits = np.ndarray(shape=(len(buf),), dtype=">u8", buffer=padded, strides=(1,))
    here, group = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
    steps = [*range(0, max(1, depth - 7), 8)]
    if steps[-1] + 8 < depth:
        steps.append(depth - 8)
    for step in steps:
        digit = digits[at[here] + step].astype(np.uint64)
        order = np.lexsort((digit, group))
        here, group, digit = here[order], group[order], digit[order]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])])
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1
        here, group = here[several], group[several]
        if not len(here):
            return out
    out[here] = group
    return out


def later_ones(classes: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a window has an equal that begins earlier (smaller document, or earlier in it)."""
    late = np.zeros(len(classes), dtype=bool)
    some = np.flatnonzero(classes >= 0)
    order = some[np.lexsort((start[some], doc[some], classes[some]))]
    late[order[1:]] = classes[order[1:]] == classes[order[:-1]]
    return late


def anchored(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of every anchor; places count in the slice, windows do not cross documents."""
    none = np.zeros(0, dtype=np.int64)
    reach = DEPTH - ANCHOR + 1
    if len(buf) < DEPTH:
        return np.zeros(0, dtype=np.uint64), none, none, none
    with np.errstate(over="ignore"):
        full = rolling_hash(prefix_hash(buf), ANCHOR, 17)
    least, width = full & ~_PLACE, 1
    least |= np.arange(len(least), dtype=np.uint64)
    while width * 2 <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = reach - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    change = np.zeros(len(least) + 1, dtype=np.int8)
    long = np.flatnonzero(np.diff(off) >= DEPTH)
    np.add.at(change, off[long], 1)
    np.add.at(change, off[long + 1] - DEPTH + 1, -1)
    valid = np.cumsum(change[:-1], dtype=np.int8).view(bool)
    # A run of windows begins or ends where the next one has another anchor or is none.
    parted = (least[1:] != least[:-1]) | ~(valid[1:] & valid[:-1])
    first = np.flatnonzero(valid & np.concatenate([[True], parted]))
    last = np.flatnonzero(valid & np.concatenate([parted, [True]]))
    place = (least[first] & _PLACE).astype(np.int64)
    return full[place], place, first, last


def _buckets(total_bytes: int) -> int:
    return max(8, int(total_bytes * 20 / 35 / BUCKET_BYTES) + 1)


def repeated_anchors(texts: DataFrame, buckets: int) -> DataFrame:
    """(doc, at array<int>, often array<boolean>): the places of anchors whose string occurs more than once."""

    def pack(batches):
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, _, buf, off in text_slices(batch.column(1), SLICE):
                h, place, _, _ = anchored(buf, off)
                owner = np.searchsorted(off, place, side="right") - 1
                held.append((h, ids[i + owner], (place - off[owner]).astype(np.int32)))
                size += len(h)
                if size > 1 << 20:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    def send(held) -> pa.RecordBatch:
        h, doc, at = (np.concatenate([x[k] for x in held]) for k in range(3))
        bucket = (h >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        h, doc, at, bucket = h[order], doc[order], at[order], bucket[order]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(h) else [0]
        blobs = [h[i:j].tobytes() + doc[i:j].astype(np.int64).tobytes() + at[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
        return pa.record_batch([pa.array(bucket[edges[:-1]].astype(np.int64) if len(h) else [], pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "packed"])

    def count(table: pa.Table) -> pa.Table:
        parts = []
        for blob in table.column("packed").to_pylist():
            n = len(blob) // 20
            parts.append((np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.int64, n, 8 * n), np.frombuffer(blob, np.int32, n, 16 * n)))
        h, doc, at = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        number = np.empty(len(h), dtype=np.int64)
        group = np.cumsum(new) - 1
        number[order] = np.bincount(group)[group]
        keep = np.flatnonzero(number > 1)
        keep = keep[np.argsort(doc[keep], kind="stable")]
        doc, at, often = doc[keep], at[keep], number[keep] >= FREQUENT
        edges = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, dtype=np.int64)
        offsets = pa.array(np.append(edges, len(doc)), pa.int32())
        return pa.table({"doc": pa.array(doc[edges], pa.int64()), "at": pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), "often": pa.ListArray.from_arrays(offsets, pa.array(often, pa.bool_()))})

    found = texts.mapInArrow(pack, "bucket long, packed binary").groupBy("bucket").applyInArrow(count, "doc long, at array<int>, often array<boolean>")
    return found.groupBy("doc").agg(F.flatten(F.collect_list("at")).alias("at"), F.flatten(F.collect_list("often")).alias("often"))


def _runs(late: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of runs of chosen windows with consecutive starts in a row."""
    i = np.flatnonzero(late)
    if not len(i):
        return i, i, i
    new = np.concatenate([[True], (row[i[1:]] != row[i[:-1]]) | (start[i[1:]] != start[i[:-1]] + 1)])
    edges = np.flatnonzero(new)
    return row[i[edges]], start[i[edges]], start[i[np.append(edges[1:], len(i)) - 1]]


_RUN = "key long, doc long, start int, windows int, bytes binary"


def _send_windows(batches):
    """Runs of windows with a repeated anchor, without those that a window of the slice precedes; the latter as verdicts (bytes null)."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        lists, often_lists = batch.column(2), batch.column(3)
        for i, j, buf, off in text_slices(batch.column(1), SLICE):
            h, place, first, last = anchored(buf, off)
            part, part_often = lists.slice(i, j - i), often_lists.slice(i, j - i)
            per = np.diff(part.offsets.to_numpy())
            wanted = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(off[:-1], per)
            often = part_often.flatten().to_numpy(zero_copy_only=False).astype(bool)
            order = np.argsort(wanted)
            wanted, often = wanted[order], often[order]
            # A place can be the anchor of several runs of windows.
            at = np.searchsorted(wanted, place)
            hit = at < len(wanted)
            hit[hit] = wanted[at[hit]] == place[hit]
            h, first, last, often = h[hit], first[hit], last[hit], often[at[hit]]
            sizes = last - first + 1
            anchor = np.repeat(np.arange(len(h)), sizes)
            window = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first, sizes)
            owner = np.searchsorted(off, window, side="right") - 1
            doc, start = ids[i + owner], window - off[owner]
            late = later_ones(radix_classes(buf, window), doc, start)
            row, a, b = _runs(late, anchor, window)
            whose = np.searchsorted(off, a, side="right") - 1
            if len(a):
                keys = mix(a.astype(np.uint64), 5).view(np.int64)
                yield pa.record_batch([pa.array(keys), pa.array(ids[i + whose], pa.int64()), pa.array((a - off[whose]).astype(np.int32)), pa.array((b - a + 1).astype(np.int32)), pa.nulls(len(a), pa.binary())], names=["key", "doc", "start", "windows", "bytes"])
            # Windows of frequent anchors go one by one, dealt by their content.
            alone = ~late & often[anchor]
            row, a, b = _runs(~late & ~alone, anchor, window)
            key = h[row].view(np.int64)
            single = window[alone]
            if len(single):
                with np.errstate(over="ignore"):
                    own = span_hash(prefix_hash(buf), single, single + DEPTH, 19).view(np.int64)
                key, a, b = np.concatenate([key, own]), np.concatenate([a, single]), np.concatenate([b, single])
            for s in range(0, len(a), 8192):
                x, y = a[s : s + 8192], b[s : s + 8192]
                whose = np.searchsorted(off, x, side="right") - 1
                sizes = y - x + DEPTH
                upto = np.concatenate([[0], np.cumsum(sizes)])
                data = buf[np.arange(upto[-1]) - np.repeat(upto[:-1] - x, sizes)]
                packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.record_batch([pa.array(key[s : s + 8192], pa.int64()), pa.array(ids[i + whose], pa.int64()), pa.array((x - off[whose]).astype(np.int32)), pa.array((y - x + 1).astype(np.int32)), packed], names=["key", "doc", "start", "windows", "bytes"])


def _settle(batches):
    """Removed runs (doc, start, stop) from runs of windows that come ordered by key."""

    def out(doc, start, stop) -> pa.RecordBatch:
        return pa.record_batch([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["doc", "start", "stop"])

    def solve(table: pa.Table):
        buf, off = flat(table.column("bytes").combine_chunks())
        doc, start, windows = (table.column(c).to_numpy().astype(np.int64) for c in ("doc", "start", "windows"))
        row = np.repeat(np.arange(len(doc)), windows)
        inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        at = off[row] + inner
        late = later_ones(radix_classes(buf, at), doc[row], start[row] + inner)
        which, a, b = _runs(late, row, inner)
        return out(doc[which], start[which] + a, start[which] + b + DEPTH)

    held, size = [], 0
    for batch in batches:
        known = batch.filter(pa.compute.is_null(batch.column("bytes")))
        if known.num_rows:
            first = known.column("start").to_numpy().astype(np.int64)
            yield out(known.column("doc"), first, first + known.column("windows").to_numpy() - 1 + DEPTH)
        rest = batch.filter(pa.compute.is_valid(batch.column("bytes")))
        if not rest.num_rows:
            continue
        held.append(rest)
        size += rest.column("bytes").nbytes
        if size > 2 << 20:
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1], side="left"))
            if cut:
                # Whole keys, a few megabytes at a time.
                ends = [0]
                sizes = np.cumsum(table.column("windows").to_numpy()[:cut] + DEPTH - 1)
                change = np.append(np.flatnonzero(key[1:cut] != key[: cut - 1]) + 1, cut)
                for c in change:
                    if sizes[c - 1] - (sizes[ends[-1] - 1] if ends[-1] else 0) > 1 << 20 or c == cut:
                        ends.append(int(c))
                for x, y in zip(ends[:-1], ends[1:], strict=True):
                    yield solve(table.slice(x, y - x))
                held = table.slice(cut).to_batches()
                size = sum(b.column("bytes").nbytes for b in held)
    if held:
        yield solve(pa.Table.from_batches(held))


def _of_ids(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _cut(batches):
    """n_removed, n_spans and the digest of what is left."""
    for batch in batches:
        buf, off = flat(batch.column(1))
        rows = []
        for k, spans in enumerate(batch.column(2).to_pylist()):
            text = buf[off[k] : off[k + 1]]
            change = np.zeros(len(text) + 1, dtype=np.int64)
            ends = np.array([(s["start"], s["stop"]) for s in spans], dtype=np.int64)
            np.add.at(change, ends[:, 0], 1)
            np.add.at(change, ends[:, 1], -1)
            gone = np.cumsum(change[:-1]) > 0
            runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((len(text), int(gone.sum()), runs, hashlib.sha256(text[~gone].tobytes()).hexdigest()))
        yield pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(copies, spans) of rows (id, text) with keys (id, sha, n_bytes): ids that are copies of an earlier text;
    and (id, spans) of the other documents that hold a repeat."""
    long = keys.filter(F.col("n_bytes") >= DEPTH)
    first = settled(long.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("most")).filter("first != most").select("sha", "first"))
    copies = settled(long.join(small(first, GROUPS), "sha").filter("id != first").select("id").distinct())
    once = rows.filter(F.octet_length("text") >= DEPTH).join(_of_ids(copies), "id", "left_anti")
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    anchors = settled(repeated_anchors(once.select("id", "text"), _buckets(total)))
    texts = rows.join(_of_ids(anchors.select(F.col("doc").alias("id"))), "id", "left_semi").dropDuplicates(["id"])
    sent = texts.join(anchors, texts["id"] == anchors["doc"]).select("id", "text", "at", "often").mapInArrow(_send_windows, _RUN)
    runs = sent.repartition("key").sortWithinPartitions("key").mapInArrow(_settle, "doc long, start long, stop long")
    spans = runs.groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return copies, settled(spans)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    rows = of_texts(docs, id_col, text_col)
    rows, keys, names = identified(rows, keyed(rows))
    copies, spans = repeated_spans(rows, keys)
    touched = _of_ids(spans.select("id"))
    cut = rows.join(touched, "id", "left_semi").join(spans, "id").select("id", "text", "spans").mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    rest = keys.join(touched, "id", "left_anti").join(small(copies.withColumn("copy", F.lit(True))), "id", "left")
    gone = F.coalesce("copy", F.lit(False))
    rest = rest.select("id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"), F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.lower(F.hex("sha"))).alias("kept_sha256"))
    found = cut.unionByName(rest)
    if names is not None:
        found = found.join(small(names.select(F.col("number").alias("id"), F.col("id").alias("own"))), "id").withColumn("id", F.col("own"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_suffix_dedup(spark, sf_dir) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
