"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word has a restaurant for what follows it; all of them share one parent,
the unigram restaurant, whose base is uniform over the words seen and one
unseen. Customers are first seated one after another; then Gibbs sweeps take each one up and
seat it again by the restaurant's conditional, with table sizes and the number of tables as they
then are. Tables of the context restaurants are the customers of the parent, whose counts follow
after each sweep. Predictive probabilities are averaged over several sweeps.

Every context has a restaurant of its own. Totals of those of the ``WORDS`` most frequent words (the
dictionary) go to every task; those of all others (rare ones, named by the context's hash) are added up
after the second pass and sent to the buckets that hold their cells. The
counts of (context, word) cover every training token, are packed in blocks and
dealt by word, so that a word's customers meet in one task. Words of the
dictionary are dealt by (word, context), after a rare context by the context alone, and the few cells that hold more than
1 / HOT_SHARE of all tokens are broadcast with the mean of their seatings (at most
HOT_SHARE of them, or one for each eighth of a bucket's tokens) and scored where the text is.
Totals of the context restaurants and of dictionary words in the parent come from the first
seating and stay during the sweeps; all else that a sweep needs is in the bucket.

Three passes over the texts: word counts; cells and their seating; scores.

Defined cases: null text counts as empty and is one end token; without training
documents all counts are 0 and the model is uniform over one unseen word; an
empty table gives an empty result; repeated rows and rows that share an id are
documents of their own, with a row each; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.llm.flat import lower_ascii, mix, prefix_hash, span_hash, text_slices, words
from floeline.llm.shared import documents, release, remainder, settled, spending

WORDS, HOT_SHARE = 16384, 100_000
#: Restaurants whose totals every task has: of dictionary words, and of a document's start.
START = WORDS
RESTAURANTS = START + 1
#: How a block writes that a rare context's hash is listed beside.
RARE = 65535
#: The end token's hash, by rule.
END = np.uint64(0x5EED0000000000E1)
#: Strength and discount of the context restaurants, strength of the parent.
THETA, DISCOUNT, THETA_0 = 4.0, 0.8, 1.0
#: Sweeps whose predictive probabilities are averaged, and sweeps before them.
SEATINGS, BURN_IN = 3, 1
#: Tokens that a task gathers before it sends them on, and that a bucket should hold.
FLUSH, BUCKET_TOKENS = 1_500_000, 2_000_000
#: Parts in which a sweep takes up the customers of a cell; up to so many customers go one by one.
TURNS = 32


@dataclass
class Counts:
    """What every task gets; all of fixed bound."""

    tokens: int = 0
    distinct: int = 0
    discount_0: float = 0.75
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.uint64))  # sorted hashes
    counts: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))
    guests: np.ndarray | None = None  # the parent's customers of each dictionary word
    tables: np.ndarray | None = None  # the parent's tables of them
    room_customers: np.ndarray | None = None  # of each context restaurant
    room_tables: np.ndarray | None = None
    guests_all: float = 0.0
    tables_all: float = 0.0
    hot_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, dtype=np.int64))  # word * 2**20 + restaurant, sorted
    hot_customers: np.ndarray = field(default_factory=lambda: np.zeros(0))
    hot_tables: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place in the dictionary, or -1."""
        if not len(self.words):
            return np.full(len(h), -1, dtype=np.int64)
        # Of many hashes, the few words that share the first 18 bits are looked at.
        if len(h) > 1 << 18:
            begin = np.searchsorted(self.words >> np.uint64(46), np.arange((1 << 18) + 1, dtype=np.uint64))
            if (most := int(np.diff(begin).max())) <= 8:
                spot, out = begin[(h >> np.uint64(46)).astype(np.int64)], np.full(len(h), -1, dtype=np.int64)
                padded = np.append(self.words, np.full(most, self.words[0] if most else 0))
                for step in range(most):
                    hit = np.flatnonzero(padded[spot + step] == h)
                    out[hit] = (spot[hit] + step) % len(self.words)
                return out
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1))

    def new_dish(self) -> float:
        """Weight of a new table of a word in the parent."""
        return (THETA_0 + self.discount_0 * self.tables_all) / (self.distinct + 1)

    def parent(self, guests: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return (np.maximum(guests - self.discount_0 * tables, 0) + self.new_dish()) / (THETA_0 + self.guests_all)

    def predictive(self, room: np.ndarray, customers: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        out = np.maximum(customers - DISCOUNT * tables, 0) + (THETA + DISCOUNT * self.room_tables[room]) * parent
        return out / (THETA + self.room_customers[room])


def seat(customers: np.ndarray, new_weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that the customers of each dish occupy, drawn one customer after another.

    A customer opens a table with weight ``new_weight`` against those who sit, less the discount
    of each table. From the 33rd customer on, an eighth of those seated is drawn at once.
    """
    tables = np.minimum(customers, 1).astype(np.float64)
    seated, active = 1, np.flatnonzero(customers > 1)
    while len(active):
        take = np.minimum(1 if seated < 32 else seated // 8, customers[active] - seated).astype(np.int64)
        weight = new_weight[active]
        share = weight / (weight + np.maximum(seated - discount * tables[active], 1e-12))
        tables[active] += (rng.random(len(active)) < share) if seated < 32 else rng.binomial(take, share)
        seated += 1 if seated < 32 else seated // 8
        active = active[customers[active] > seated]
    return tables


class Seating:
    """Who sits where in cells (restaurant, dish), for Gibbs sweeps that take customers up and seat them again.

    Every customer has a place of its own, and a table is named by a place of its cell. Cells of one
    customer have one table whatever happens and are left out.
    """

    def __init__(self, customers: np.ndarray, tables: np.ndarray):
        """Customers are first dealt to the given numbers of tables in turn."""
        self.tables = tables.astype(np.float64).copy()
        # The largest first, so the cells that have a customer in a turn come before all others.
        self.cells = np.flatnonzero(customers > 1)
        self.cells = self.cells[np.argsort(-customers[self.cells], kind="stable")]
        self.size = customers[self.cells].astype(np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.cell = np.repeat(np.arange(len(self.size)), self.size)
        inner = np.arange(len(self.cell)) - self.begin[self.cell]
        self.at = self.begin[self.cell] + inner % np.maximum(tables[self.cells].astype(np.int64), 1)[self.cell]
        self.seated = np.bincount(self.at, minlength=len(self.at))
        # Customers of a turn: a TURNS-th of each cell, one at most in cells of up to TURNS.
        self.turns = np.argsort((inner % TURNS).astype(np.int8), kind="stable")
        self.ends = np.cumsum(np.bincount(inner % TURNS, minlength=TURNS))

    def _free(self, places: np.ndarray) -> np.ndarray:
        """A table that nobody sits at for each customer (at these places) who opens one; they differ."""
        out = places.copy()
        while True:
            # Whose own place is taken looks on, place after place of the cell, until none clash.
            order = np.argsort(out, kind="stable")
            twice = np.zeros(len(out), dtype=bool)
            twice[order[1:]] = out[order[1:]] == out[order[:-1]]
            clash = np.flatnonzero(twice | (self.seated[out] > 0))
            if not len(clash):
                return out
            c = self.cell[places[clash]]
            out[clash] = self.begin[c] + (out[clash] - self.begin[c] + 1) % self.size[c]

    def sweep(self, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
        """Every customer once gets up and sits down by the restaurant's conditional; tables of each cell after it.

        ``weight``: of a new table, for each cell. Larger cells' customers of one turn do not see each other.
        """
        weight, tables, standing = weight[self.cells], self.tables[self.cells], np.zeros(len(self.at), dtype=bool)
        for who in np.split(self.turns, self.ends[:-1]):
            if not len(who):
                break
            cell, spots = self.cell[who], self.at[who]
            up = np.bincount(cell)
            among = len(up)
            np.subtract.at(self.seated, spots, 1)
            left = np.unique(spots[self.seated[spots] == 0])
            tables[:among] -= np.bincount(self.cell[left], minlength=among)
            new = weight[:among] / (weight[:among] + np.maximum(self.size[:among] - up - discount * tables[:among], 1e-12))
            opens = rng.random(len(who)) < new[cell]
            mates = who[~opens]
            goes = np.empty(len(mates), dtype=np.int64)
            waiting = np.arange(len(mates))
            standing[who] = True
            while len(waiting):
                # A table by its guests less the discount: where another customer sits, who is up or not; taken as often as the discount leaves.
                me = mates[waiting]
                c = self.cell[me]
                other = self.begin[c] + (me - self.begin[c] + 1 + (rng.random(len(waiting)) * (self.size[c] - 1)).astype(np.int64)) % self.size[c]
                table = self.at[other]
                n = self.seated[table]
                ok = ~standing[other] & ((tables[c] == 1) | (rng.random(len(waiting)) * n < n - discount))
                goes[waiting[ok]] = table[ok]
                waiting = waiting[~ok]
            standing[who] = False
            fresh = who[opens]
            self.at[fresh] = self._free(fresh)
            self.at[mates] = goes
            np.add.at(self.seated, self.at[who], 1)
            tables[:among] += np.bincount(self.cell[fresh], minlength=among)
        self.tables[self.cells] = tables
        return self.tables


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hash of the token before or 0, document): each document's words, then its end."""
    n = len(off) - 1
    low = lower_ascii(buf)
    with np.errstate(over="ignore"):
        s, e, doc = words(low, off)
        h = span_hash(prefix_hash(low), s, e, 23) | np.uint64(1) if len(s) else np.zeros(0, dtype=np.uint64)
    per = np.bincount(doc, minlength=n)
    out = np.full(len(h) + n, END, dtype=np.uint64)
    out[np.arange(len(h)) + doc] = h
    owner = np.repeat(np.arange(n), per + 1)
    before = np.concatenate([[np.uint64(0)], out[:-1]])
    before[np.concatenate([[0], np.cumsum(per + 1)])[:-1]] = 0
    return out, before, owner


def _rooms(counts: Counts, before: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The restaurant of each context: its place in the dictionary, START, or for all others the hash as a negative number.

    ``at``: places of the tokens themselves, where ``before`` are all of them, one on.
    """
    at = counts.find(before) if at is None else np.concatenate([[-1], at[:-1]])
    return np.where(before == 0, START, np.where(at >= 0, at, (before | np.uint64(1 << 63)).view(np.int64)))


def _coded(room: np.ndarray) -> tuple[bytes, bytes]:
    """(hashes of the rare ones, 16 bits of each)."""
    rare = room < 0
    return room[rare].tobytes(), np.where(rare, RARE, room).astype(np.uint16).tobytes()


def _decoded(rare: np.ndarray, code: np.ndarray) -> np.ndarray:
    room = code.astype(np.int64)
    room[code == RARE] = rare
    return room


def _totals_packed(head: int, room: np.ndarray, customers: np.ndarray, tables: np.ndarray) -> bytes:
    return np.array([head, len(room)], dtype=np.int64).tobytes() + pa.compress(room.tobytes() + customers.astype(np.uint32).tobytes() + tables.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def _totals_of(blob: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(head, rare contexts in order, customers, tables)."""
    head, n = map(int, np.frombuffer(blob, np.int64, 2))
    body = pa.decompress(blob[16:], decompressed_size=16 * n, codec="zstd", asbytes=True)
    return head, np.frombuffer(body, np.int64, n), np.frombuffer(body, np.uint32, n, 8 * n), np.frombuffer(body, np.uint32, n, 12 * n)


def rare_totals(parts: DataFrame) -> DataFrame:
    """(bucket, packed): for each bucket the totals of the rare contexts that it holds, of all buckets' sums (key, packed)."""

    def add(table: pa.Table) -> pa.Table:
        got = [_totals_of(b) for b in table.column("packed").to_pylist()]
        room, place = np.unique(np.concatenate([g[1] for g in got]), return_inverse=True)
        customers, tables = (np.bincount(place, weights=np.concatenate([g[k] for g in got])) for k in (2, 3))
        spots = np.split(place, np.cumsum([len(g[1]) for g in got])[:-1])
        return pa.table({"bucket": pa.array([g[0] for g in got], pa.int64()), "packed": pa.array([_totals_packed(0, g[1], customers[at], tables[at]) for g, at in zip(got, spots, strict=True)], pa.binary())})

    return parts.groupBy("key").applyInArrow(add, "bucket long, packed binary")


def _flushes(batches, keep_all: bool):
    """Parts of about FLUSH tokens: (ids, held out, hash, before, document)."""
    held, size, base = [], 0, 0
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        out = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for i, j, buf, off in text_slices(batch.column(2)):
            h, before, owner = _tokens(buf, off)
            if not keep_all:
                train = ~out[i + owner]
                h, before, owner = h[train], before[train], owner[train]
            held.append((ids[i:j], out[i:j], h, before, owner + base))
            base += j - i
            size += len(h)
            if size >= FLUSH:
                yield tuple(np.concatenate([x[k] for x in held]) for k in range(5))
                held, size, base = [], 0, 0
    if held:
        yield tuple(np.concatenate([x[k] for x in held]) for k in range(5))


def _short(x: np.ndarray, below: int) -> np.ndarray:
    """The same numbers, all under ``below``, in 16 bits where they fit: these are sorted by radix, in the same order."""
    return x.astype(np.uint16) if below <= 65536 else x


def _split(bucket: np.ndarray, pack) -> pa.RecordBatch:
    """Rows (bucket, packed) of what is ordered by bucket."""
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, dtype=np.int64)
    return pa.record_batch([pa.array(bucket[edges[:-1]] if len(bucket) else [], pa.int64()), pa.array([pack(i, j) for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], names=["bucket", "packed"])


def count_words(rows: DataFrame, buckets: int) -> Counts:
    """First pass: N, V, counts of counts, pools, and the dictionary."""

    def send(batches):
        for _, _, h, _, _ in _flushes(batches, False):
            u, c = np.unique(h, return_counts=True)
            bucket = (u >> np.uint64(8)).astype(np.int64) % buckets
            order = np.argsort(_short(bucket, buckets), kind="stable")
            u, c, bucket = u[order], c[order].astype(np.uint32), bucket[order]
            yield _split(bucket, lambda i, j, u=u, c=c: u[i:j].tobytes() + c[i:j].tobytes())

    def merge(table: pa.Table) -> pa.Table:
        parts = [(np.frombuffer(b, np.uint64, len(b) // 12), np.frombuffer(b, np.uint32, len(b) // 12, len(b) // 12 * 8)) for b in table.column("packed").to_pylist()]
        u, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        c = np.bincount(place, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        top = np.argsort(-c, kind="stable")[:WORDS]
        # kind 0: a word; kind 1: this bucket's sums.
        kind = np.concatenate([np.zeros(len(top), dtype=np.int32), [1]])
        word = np.concatenate([u[top].view(np.int64), [len(u)]])
        number = np.concatenate([c[top], [c.sum()]])
        ones = np.concatenate([np.zeros(len(top), dtype=np.int64), [int((c == 1).sum())]])
        twos = np.concatenate([np.zeros(len(top), dtype=np.int64), [int((c == 2).sum())]])
        return pa.table({"kind": pa.array(kind, pa.int32()), "word": pa.array(word), "n": pa.array(number), "ones": pa.array(ones), "twos": pa.array(twos)})

    with spending(rows.sparkSession):
        merged = settled(rows.mapInArrow(send, "bucket long, packed binary").groupBy("bucket").applyInArrow(merge, "kind int, word long, n long, ones long, twos long"))
    s = merged.filter("kind = 1").agg(F.sum("word"), F.sum("n"), F.sum("ones"), F.sum("twos")).first()
    if not s[1]:
        return Counts()
    # Only words at least as frequent as a bin that leaves WORDS of them go to the driver, not the first of every task.
    listed = merged.filter("kind = 0").withColumn("bin", F.floor(F.log2("n") * 16))
    least, so_far = 0, 0
    for r in listed.groupBy("bin").agg(F.count("*").alias("words")).orderBy(F.desc("bin")).collect():
        least, so_far = r["bin"], so_far + r["words"]
        if so_far >= WORDS:
            break
    top = listed.filter(F.col("bin") >= least).orderBy(F.desc("n"), "word").limit(WORDS).collect()
    h, c = np.array([r["word"] for r in top], dtype=np.int64).view(np.uint64), np.array([r["n"] for r in top], dtype=np.int64)
    order = np.argsort(h)
    return Counts(int(s[1]), int(s[0]), min(0.95, max(0.1, s[2] / max(1, s[2] + 2 * s[3]))), h[order], c[order])


def _bucket_of(counts: Counts, h: np.ndarray, at: np.ndarray, room: np.ndarray, buckets: int) -> np.ndarray:
    """By word; for dictionary words by word and context, or by the context if that is rare."""
    with np.errstate(over="ignore"):
        key = np.where(at >= 0, np.where(room < 0, mix(room.view(np.uint64), 37), mix(h + room.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 31)), mix(h, 31))
    return (key % np.uint64(buckets)).astype(np.int64)


def _cells(word: np.ndarray, room: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each cell, word, room) of cells sorted by word and room; sums of n come by reduceat."""
    order = np.lexsort((room, word))
    w, r = word[order], room[order]
    first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (r[1:] != r[:-1])])) if len(w) else np.zeros(0, dtype=np.int64)
    return order, first, w[first], r[first]


def _own_guests(counts: Counts, word: np.ndarray, rooms: np.ndarray, customers: np.ndarray, rng: np.random.Generator):
    """First seating of cells, given the customers of each one's restaurant, and the parent's customers and tables of each word that is not in the dictionary."""
    at = counts.find(word)
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    spread = np.diff(np.append(starts, len(word)))
    own = np.repeat(np.add.reduceat(customers, starts), spread)
    total = np.where(at >= 0, counts.counts[np.maximum(at, 0)] if len(counts.counts) else 0, own)
    tables = seat(customers, (THETA + DISCOUNT * np.maximum(rooms, 1) ** 0.8) * counts.unigram(total), DISCOUNT, rng)
    guests = np.add.reduceat(tables, starts)
    upper = seat(guests.astype(np.int64), np.full(len(starts), (THETA_0 + counts.discount_0 * counts.distinct) / (counts.distinct + 1)), counts.discount_0, rng)
    return at, starts, spread, own, tables, guests, upper


def hot_seatings(counts: Counts) -> np.ndarray:
    """Mean tables of the hot cells over SEATINGS seatings given all totals, as other cells are seated.

    Predictive probabilities are linear in the tables, so the mean's are the mean of the seatings'.
    """
    who, room = counts.hot_keys >> 20, counts.hot_keys & ((1 << 20) - 1)
    weight = (THETA + DISCOUNT * counts.room_tables[room]) * counts.parent(counts.guests[who], counts.tables[who])
    rng = np.random.default_rng(11)
    return sum(seat(counts.hot_customers.astype(np.int64), weight, DISCOUNT, rng) for _ in range(SEATINGS)) / SEATINGS


def hot_from(tokens: int) -> int:
    """Customers from which a cell is hot: one in HOT_SHARE of all, at most an eighth of a bucket."""
    return max(50, min(tokens // HOT_SHARE, BUCKET_TOKENS // 8))


def seated(rows: DataFrame, counts: Counts, buckets: int) -> tuple[Counts, DataFrame]:
    """Second pass: all cells' customers, their first seating, and the totals of all restaurants.

    Those of rare contexts come as a table, see ``rare_totals``; held-out documents' cells of them are sent
    too, without customers, so that the third pass finds them where it needs them.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    limit = hot_from(counts.tokens)

    def send(batches):
        k = shared.value
        for _, out, h, before, doc in _flushes(batches, True):
            room, train = _rooms(k, before), ~out[doc]
            need = train | (room < 0)
            h, room, train = h[need], room[need], train[need]
            if not len(h):
                continue
            order, first, w, r = _cells(h, room, None)
            n = np.add.reduceat(train[order].astype(np.uint32), first)
            bucket = _bucket_of(k, w, k.find(w), r, buckets)
            order = np.argsort(_short(bucket, buckets), kind="stable")
            w, r, n, bucket = w[order], r[order], n[order].astype(np.uint32), bucket[order]

            def pack(i, j, w=w, r=r, n=n):
                new = np.flatnonzero(np.concatenate([[True], w[i + 1 : j] != w[i : j - 1]]))
                size = np.diff(np.append(new, j - i)).astype(np.uint32)
                rare, code = _coded(r[i:j])
                head = np.array([len(new), len(rare) // 8, j - i], dtype=np.int64)
                return head.tobytes() + pa.compress(w[i:j][new].tobytes() + rare + size.tobytes() + n[i:j].tobytes() + code, codec="zstd", asbytes=True)

            yield _split(bucket, pack)

    def merge(table: pa.Table) -> pa.Table:
        k = shared.value
        parts = []
        for b in table.column("packed").to_pylist():
            u, q, m = map(int, np.frombuffer(b, np.int64, 3))
            body, at = pa.decompress(b[24:], decompressed_size=12 * u + 8 * q + 6 * m, codec="zstd", asbytes=True), 8 * (u + q)
            size = np.frombuffer(body, np.uint32, u, at)
            room = _decoded(np.frombuffer(body, np.int64, q, 8 * u), np.frombuffer(body, np.uint16, m, at + 4 * u + 4 * m))
            parts.append((np.repeat(np.frombuffer(body, np.uint64, u), size), room, np.frombuffer(body, np.uint32, m, at + 4 * u)))
        word, room, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order, first, word, room = _cells(word, room, n)
        customers = np.add.reduceat(n[order].astype(np.int64), first)
        bucket, listed = table.column("bucket")[0].as_py(), room >= 0
        rare, place = np.unique(room[~listed], return_inverse=True)
        met = np.bincount(place, weights=customers[~listed], minlength=len(rare))
        # A dictionary word's restaurant has a customer for each time that the word occurs, a document's start for each end; of a rare one, those in the bucket.
        known = np.append(k.counts[: len(k.words)], np.zeros(RESTAURANTS - len(k.words)))
        known[START] = k.counts[k.find(np.array([END]))[0]] if len(k.words) else 0
        rooms = known[np.maximum(room, 0)]
        rooms[~listed] = met[place]
        at, starts, _, _, tables, guests, upper = _own_guests(k, word, rooms, customers, np.random.default_rng(bucket))
        # kind 0: a restaurant's sums; 1: a dictionary word's guests; 2: guests and tables of all other words; 3: a hot cell; 4: sums of rare restaurants.
        sums = (np.bincount(room[listed], weights=x[listed], minlength=RESTAURANTS) for x in (customers, tables))
        out = [(0, r, float(c), float(t)) for r, c, t in zip(np.arange(RESTAURANTS), *sums, strict=True) if c]
        known = at[starts]
        out += [(1, int(a), float(g), 0.0) for a, g in zip(known[known >= 0], guests[known >= 0], strict=True)]
        out.append((2, 0, float(guests[known < 0].sum()), float(upper[known < 0].sum())))
        hot = np.flatnonzero((customers >= limit) & (at >= 0) & listed)
        out += [(3, int(at[i]) << 20 | int(room[i]), float(customers[i]), 0.0) for i in hot]
        blobs = [None] * len(out)
        spent = np.bincount(place, weights=tables[~listed], minlength=len(rare))
        owner = (mix(rare.view(np.uint64), 41) % np.uint64(owners)).astype(np.int64)
        for who in np.unique(owner):
            mine = owner == who
            out.append((4, int(who), 0.0, 0.0))
            blobs.append(_totals_packed(bucket, rare[mine], met[mine], spent[mine]))
        return pa.table({"kind": pa.array([x[0] for x in out], pa.int32()), "key": pa.array([int(x[1]) for x in out], pa.int64()), "a": pa.array([x[2] for x in out], pa.float64()), "b": pa.array([x[3] for x in out], pa.float64()), "packed": pa.array(blobs, pa.binary())})

    owners = 1 + buckets // 8
    with spending(rows.sparkSession):
        made = settled(rows.mapInArrow(send, "bucket long, packed binary").groupBy("bucket").applyInArrow(merge, "kind int, key long, a double, b double, packed binary"))
        # At most RESTAURANTS + WORDS + 1 + HOT_SHARE rows.
        got = made.filter("kind < 4").groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    counts.room_customers, counts.room_tables = np.zeros(RESTAURANTS), np.zeros(RESTAURANTS)
    counts.guests = np.zeros(len(counts.words))
    hot = []
    for r in got:
        if r["kind"] == 0:
            counts.room_customers[r["key"]], counts.room_tables[r["key"]] = r["a"], r["b"]
        elif r["kind"] == 1:
            counts.guests[r["key"]] = r["a"]
        elif r["kind"] == 2:
            counts.guests_all, counts.tables_all = r["a"], r["b"]
        else:
            hot.append((r["key"], r["a"]))
    weight = np.full(len(counts.words), (THETA_0 + counts.discount_0 * counts.distinct) / (counts.distinct + 1))
    counts.tables = seat(counts.guests.astype(np.int64), weight, counts.discount_0, np.random.default_rng(7))
    counts.guests_all += counts.guests.sum()
    counts.tables_all += counts.tables.sum()
    if hot:
        hot.sort()
        counts.hot_keys, counts.hot_customers = np.array([x[0] for x in hot], dtype=np.int64), np.array([x[1] for x in hot])
        counts.hot_tables = hot_seatings(counts)
    shared.unpersist()
    return counts, rare_totals(made.filter("kind = 4").select("key", "packed"))


def seat_all(rows: DataFrame, counts: Counts, buckets: int) -> Counts:
    """``seated`` without the rare contexts' totals."""
    return seated(rows, counts, buckets)[0]


_PART = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"
_TABLE = (np.int64, np.uint8, np.int64, np.int64, np.float64, np.float64)


def score_all(rows: DataFrame, counts: Counts, rare: DataFrame, buckets: int) -> DataFrame:
    """Third pass: (doc_id, held_out, n_tokens, n_known, base, model).

    A part's documents are numbered; buckets get the numbers only and send back one packed
    row of sums for each part, which are added up where the part's ids are.
    """
    shared = rows.sparkSession.sparkContext.broadcast(counts)

    def send(batches):
        from pyspark import TaskContext

        k = shared.value
        here, turn = TaskContext.get().partitionId(), 0
        for ids, out, h, before, doc in _flushes(batches, True):
            at, docs = k.find(h), len(ids)
            room = _rooms(k, before, at)
            # Documents of the training part come first, so that a number says which part a document is of.
            order = np.argsort(out, kind="stable")
            place = np.empty(docs, dtype=np.int64)
            place[order] = np.arange(docs)
            ids, out, doc, cut = ids[order], out[order], place[doc], int(docs - out.sum())
            known = at >= 0
            c = np.where(known, k.counts[np.maximum(at, 0)] if len(k.counts) else 0, 0)
            base = np.where(known, np.log10(k.unigram(c)), 0.0) if k.tokens else np.zeros(len(h))
            model, hot = np.zeros(len(h)), np.zeros(len(h), dtype=bool)
            if len(k.hot_keys):
                key = at << 20 | room
                spot = np.minimum(np.searchsorted(k.hot_keys, key), len(k.hot_keys) - 1)
                hot = known & (k.hot_keys[spot] == key)
                p, who = spot[hot], at[hot]
                model[hot] = np.log10(k.predictive(room[hot], k.hot_customers[p], k.hot_tables[p], k.parent(k.guests[who], k.tables[who])))
            sums = [np.bincount(doc, weights=x, minlength=docs) for x in (np.ones(len(h)), known, base, model)]
            turn += 1
            part = here * 1_000_000 + turn
            table = np.int64(docs).tobytes() + b"".join(np.ascontiguousarray(x).astype(t).tobytes() for x, t in zip((ids, out, *sums), _TABLE, strict=True))
            yield pa.record_batch([pa.array([-part], pa.int64()), pa.array([table], pa.binary())], names=["bucket", "packed"])
            rest = ~hot
            h, room, at, doc = h[rest], room[rest], at[rest], doc[rest]
            bucket = _bucket_of(k, h, at, room, buckets)
            order = np.lexsort((_short(doc, docs), room, h, _short(2 * bucket + (at < 0), 2 * buckets)))
            h, at, room, doc, bucket = h[order], at[order], room[order], doc[order].astype(np.uint32), bucket[order]

            def pack(i, j, h=h, at=at, room=room, doc=doc, docs=docs, part=part, cut=cut):
                # Dictionary words by their place in it, the others by hash and number of tokens.
                mid = i + int(np.count_nonzero(at[i:j] >= 0))
                new = np.flatnonzero(np.concatenate([[True], h[mid + 1 : j] != h[mid : j - 1]])) if mid < j else np.zeros(0, dtype=np.int64)
                size = np.diff(np.append(new, j - mid)).astype(np.uint32)
                small = doc[i:j].astype(np.uint16) if docs < 65536 else doc[i:j]
                rare, code = _coded(room[i:j])
                body = h[mid:j][new].tobytes() + size.tobytes() + at[i:mid].astype(np.uint16).tobytes() + code + small.tobytes() + rare
                return np.array([part, docs, cut, mid - i, len(new), j - i, len(body)], dtype=np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True)

            yield _split(bucket, pack)

    def solve(table: pa.Table) -> pa.Table:
        k, bucket = shared.value, table.column("bucket")[0].as_py()
        if bucket < 0:
            return pa.table({"part": pa.array([-bucket]), "bucket": pa.array([bucket]), "packed": table.column("packed")})
        words_, rooms_, docs_, train_, parts, totals = [], [], [], [], [], []
        for b in sorted(table.column("packed").to_pylist()):
            if not np.frombuffer(b, np.int64, 1)[0]:
                totals.append(_totals_of(b)[1:])
                continue
            part, d, cut, listed, u, m, size = map(int, np.frombuffer(b, np.int64, 7))
            body = pa.decompress(b[56:], decompressed_size=size, codec="zstd", asbytes=True)
            at = 0
            words_.append(k.words[np.frombuffer(body, np.uint16, listed, at + 12 * u)])
            words_.append(np.repeat(np.frombuffer(body, np.uint64, u, at), np.frombuffer(body, np.uint32, u, at + 8 * u)))
            at += 12 * u + 2 * listed
            width = 2 if d < 65536 else 4
            doc = np.frombuffer(body, np.uint16 if width == 2 else np.uint32, m, at + 2 * m).astype(np.int64)
            rooms_.append(_decoded(np.frombuffer(body, np.int64, offset=at + (2 + width) * m) if len(body) > at + (2 + width) * m else np.zeros(0, dtype=np.int64), np.frombuffer(body, np.uint16, m, at)))
            train_.append(doc < cut)
            docs_.append(doc | len(parts) << 32)
            parts.append(part)
        word, room, doc, train = np.concatenate(words_), np.concatenate(rooms_), np.concatenate(docs_), np.concatenate(train_)
        order, first, word, room = _cells(word, room, None)
        # From here on a document is its place among those that the bucket meets.
        met, doc = np.unique(doc[order], return_inverse=True)
        customers = np.add.reduceat(train[order].astype(np.int64), first)
        rng = np.random.default_rng(bucket)
        if totals:
            # Rare restaurants come after the others, in order; every one of the bucket's is among them.
            names, had, spent = (np.concatenate([t[i] for t in totals]) for i in range(3))
            order, rare = np.argsort(names), room < 0
            room[rare] = RESTAURANTS + np.searchsorted(names[order], room[rare])
            k = replace(k, room_customers=np.append(k.room_customers, had[order]), room_tables=np.append(k.room_tables, spent[order]))
        at, starts, spread, own, tables, guests, upper = _own_guests(k, word, k.room_customers[room], customers, rng)
        listed = at >= 0
        here, there = np.maximum(at, 0), np.flatnonzero(at[starts] < 0)
        seating, chance = Seating(customers, tables), np.zeros(len(word))
        for sweep in range(BURN_IN + SEATINGS):
            g, t = np.repeat(guests, spread), np.repeat(upper, spread)
            if len(k.words):
                g, t = np.where(listed, k.guests[here], g), np.where(listed, k.tables[here], t)
            parent = k.parent(g, t)
            if sweep >= BURN_IN:
                chance += k.predictive(room, customers, seating.tables, parent)
            if sweep == BURN_IN + SEATINGS - 1:
                break
            tables = seating.sweep((THETA + DISCOUNT * k.room_tables[room]) * parent, DISCOUNT, rng)
            # The tables of words that are not in the dictionary are their customers in the parent.
            guests = guests.copy()
            guests[there] = np.add.reduceat(tables, starts)[there]
            upper[there] = seat(guests[there].astype(np.int64), np.full(len(there), k.new_dish()), k.discount_0, rng)
        model = np.log10(chance / SEATINGS)
        unlisted_base = np.where(listed, 0.0, np.log10(k.unigram(own)) if k.tokens else 0.0)
        unlisted_known = np.where(listed, 0, own > 0)
        sizes = np.diff(np.append(first, len(doc)))
        known, base, model = (np.bincount(doc, weights=np.repeat(x, sizes), minlength=len(met)) for x in (unlisted_known, unlisted_base, model))
        edges = np.searchsorted(met, np.arange(len(parts) + 1) << 32)
        blobs = []
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            also = np.flatnonzero((known[i:j] != 0) | (base[i:j] != 0)) + i
            number = lambda x: (met[x] & 0xFFFFFFFF).astype(np.uint32).tobytes()
            body = base[also].tobytes() + known[also].astype(np.uint32).tobytes() + number(slice(i, j)) + number(also) + model[i:j].astype(np.float32).tobytes()
            blobs.append(np.array([j - i, len(also), len(body)], dtype=np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True))
        return pa.table({"part": pa.array(parts, pa.int64()), "bucket": pa.array([bucket] * len(parts), pa.int64()), "packed": pa.array(blobs, pa.binary())})

    def add_up(table: pa.Table) -> pa.Table:
        blobs = table.sort_by("bucket").column("packed").to_pylist()
        n, at, columns = int(np.frombuffer(blobs[0], np.int64, 1)[0]), 8, []
        for t in _TABLE:
            columns.append(np.frombuffer(blobs[0], t, n, at).copy())
            at += n * np.dtype(t).itemsize
        ids, out, tokens, known, base, model = columns
        for b in blobs[1:]:
            n, m, size = map(int, np.frombuffer(b, np.int64, 3))
            b = pa.decompress(b[24:], decompressed_size=size, codec="zstd", asbytes=True)
            doc, also = np.frombuffer(b, np.uint32, n, 12 * m), np.frombuffer(b, np.uint32, m, 12 * m + 4 * n)
            model[doc] += np.frombuffer(b, np.float32, n, 16 * m + 4 * n)
            base[also] += np.frombuffer(b, np.float64, m)
            known[also] += np.frombuffer(b, np.uint32, m, 8 * m)
        return pa.table({"doc_id": pa.array(ids), "held_out": pa.array(out.astype(bool)), "n_tokens": pa.array(tokens), "n_known": pa.array(known), "base": pa.array(base), "model": pa.array(model)})

    sums = rows.mapInArrow(send, "bucket long, packed binary").union(rare).groupBy("bucket").applyInArrow(solve, "part long, bucket long, packed binary")
    return sums.groupBy("part").applyInArrow(add_up, _PART)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), (remainder(id_col, 10) == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(8, int(size / 6 / BUCKET_TOKENS) + 1)
    counts = count_words(rows, buckets)
    counts, rare = seated(rows, counts, buckets)
    release(rows.sparkSession)
    scored = score_all(rows, counts, rare, buckets)
    return scored.select(F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(counts.tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))


def op7_hpy_score(spark, sf_dir) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
