"""BPE encoding and decoding of whole texts: speculate, verify, merge exactly where needed.

The vocabulary is of the kind with word ends: texts are normalised (NFC, white
space folded, lower case), cut into pieces, and every piece is encoded by its
own. A greedy longest-match over all distinct pieces of a slice proposes tokens.
A sequence of tokens is the BPE encoding of its piece exactly if every token
encodes to itself and every adjacent pair encodes to that pair; tables of pairs
known to be compatible test all adjacent pairs at once, and a pair that is seen
for the first time is settled by exact merging. Only pieces with a failing pair
undergo exact merging themselves.

Ids equal those of the tokenizers library for the same vocabulary file, without
added special tokens; special tokens that stand in a text are encoded as such.
Decoding joins the tokens' strings with spaces, as that library does for a
vocabulary without a decoder.

Defined cases: a null text counts as empty and has no token; an empty table
gives an empty result; repeated rows are encoded each; other columns are not
read. Memory: a slice of a megabyte of text, or one longer document.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.llm.flat import text_slices
from floeline.llm.shared import documents

#: How texts are cut into pieces, and the mark of a word's end in the vocabulary. Fixed values.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
VOCABULARY = "word_bpe_49k.json"
#: Stands for the word's end in the automaton; no byte has this code.
_END = "Ā"
_NONE = 1 << 40
#: Bytes of text that a process works on at a time; the pieces, tokens and places of them take some 35 times as much.
SLICE = 1 << 20
#: Compatibility verdicts that a process keeps.
PAIRS_KEPT = 2_000_000


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def load(path: str | None = None) -> dict:
    """Vocabulary, merges and special tokens of a tokenizer file, for ``WordBpe``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    return {"vocab": spec["model"]["vocab"], "merges": merges, "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}


class WordBpe:
    def __init__(self, spec: dict):
        import ahocorasick
        import regex

        self.special = spec["special"]
        self.strings: dict[int, str] = {i: t for t, i in spec["vocab"].items()} | {i: t for t, i in self.special.items()}
        of_char = {c: chr(b) for b, c in byte_characters().items()}
        inner = lambda t: "".join(of_char[c] for c in t.removesuffix(WORD_END)) + _END * t.endswith(WORD_END)
        self.ids = {inner(t): i for t, i in spec["vocab"].items()}
        self.texts = {i: t for t, i in self.ids.items()}
        pairs = np.array([(self.ids[inner(x)] << 20 | self.ids[inner(y)], self.ids[inner(x) + inner(y)]) for x, y in spec["merges"]], dtype=np.int64).reshape(-1, 2)
        order = np.argsort(pairs[:, 0], kind="stable")
        self.merge_keys, self.merge_ranks, self.merge_made = pairs[order, 0], order.astype(np.int64), pairs[:, 1]
        self.byte_ids = np.array([self.ids[chr(b)] for b in range(256)], dtype=np.int64)
        self.byte_end_ids = np.array([self.ids[chr(b) + _END] for b in range(256)], dtype=np.int64)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.pieces = regex.compile(PIECES).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.size = max(self.strings) + 1
        # Single tokens that encode to themselves; pairs whose verdict is known, as sorted keys.
        self.alone = np.zeros(self.size, dtype=np.int8)
        self.keys, self.good = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        encoded = [f"{self.strings.get(i, '')} ".encode() for i in range(self.size)]
        self.token_bytes = np.frombuffer(b"".join(encoded), dtype=np.uint8)
        self.token_at = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or _NONE."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.merge_keys, key), len(self.merge_keys) - 1)
        return np.where(self.merge_keys[at] == key, self.merge_ranks[at], _NONE)

    def merge_many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Exact BPE of pieces in inner form: (ids, offsets).

        All pieces advance together: in each pass every unfinished piece applies
        its best merge at all its places, from left to right.
        """
        n = len(pieces)
        ended = np.fromiter((p.endswith(_END) for p in pieces), dtype=bool, count=n)
        size = np.fromiter((len(p) for p in pieces), dtype=np.int64, count=n) - ended
        data = np.frombuffer("".join(pieces).replace(_END, "").encode("latin-1"), dtype=np.uint8)
        sym, word = self.byte_ids[data], np.repeat(np.arange(n), size)
        last = np.cumsum(size) - 1
        sym[last[ended & (size > 0)]] = self.byte_end_ids[data[last[ended & (size > 0)]]]
        place = np.arange(len(sym), dtype=np.int64)  # keeps the order of what is done
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), _NONE, dtype=np.int64)
        same = word[1:] == word[:-1]
        rank[:-1][same] = self._rank(sym[:-1][same], sym[1:][same])
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            over = best == _NONE
            if over.any():
                done.append((place[over], word[over], sym[over]))
                keep = ~over
                sym, word, rank, place, best = sym[keep], word[keep], rank[keep], place[keep], best[keep]
                if not len(sym):
                    break
            hit = rank == best
            # Of overlapping places of the same merge, every other one counts.
            at = np.arange(len(hit))
            begin = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), at, -1))
            hit &= (at - begin) % 2 == 0
            i = np.flatnonzero(hit)
            sym[i] = self.merge_made[rank[i]]
            keep = np.ones(len(sym), dtype=bool)
            keep[i + 1] = False
            changed = hit.copy()
            changed[:-1] |= hit[1:]
            # A merged place and the unit before it, which may itself be two places back, look anew.
            changed[np.maximum(i - 2, 0)] |= ~keep[np.maximum(i - 1, 0)]
            sym, word, rank, place, changed = sym[keep], word[keep], rank[keep], place[keep], changed[keep]
            c = np.flatnonzero(changed)
            rank[c] = _NONE
            c = c[c + 1 < len(sym)]
            c = c[word[c] == word[c + 1]]
            rank[c] = self._rank(sym[c], sym[c + 1])
        if not done:
            return np.zeros(0, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
        place, word, sym = (np.concatenate([d[k] for d in done]) for k in range(3))
        order = np.argsort(place, kind="stable")
        return sym[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))]).astype(np.int64)

    def _pair_verdicts(self, keys: np.ndarray) -> np.ndarray:
        """Whether each distinct pair (a << 20 | b) is compatible."""
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        if not known.all():
            fresh = keys[~known]
            ids, off = self.merge_many([self.texts[k >> 20] + self.texts[k & 0xFFFFF] for k in fresh.tolist()])
            verdict = np.diff(off) == 2
            two = off[:-1][verdict]
            verdict[verdict] = (ids[two] == fresh[verdict] >> 20) & (ids[two + 1] == fresh[verdict] & 0xFFFFF)
            if len(self.keys) > PAIRS_KEPT:
                self.keys, self.good = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
                return self._pair_verdicts(keys)
            joined = np.concatenate([self.keys, fresh])
            order = np.argsort(joined, kind="stable")
            self.keys, self.good = joined[order], np.concatenate([self.good, verdict])[order]
            at = np.searchsorted(self.keys, keys)
        return self.good[at]

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct pieces."""
        n = len(pieces)
        inner = [p.encode("utf-8", "replace").decode("latin-1") + _END for p in pieces]
        for k, p in enumerate(pieces):
            if p in self.special:
                inner[k] = _END
        ends_at = np.cumsum([len(x) for x in inner])
        found = list(self.automaton.iter_long("".join(inner)))
        last = np.fromiter((e for e, _ in found), dtype=np.int64, count=len(found))
        token = np.fromiter((v for _, v in found), dtype=np.int64, count=len(found))
        piece = np.searchsorted(ends_at, last, side="right")
        counts = np.bincount(piece, minlength=n)
        first = np.concatenate([[0], np.cumsum(counts)])
        # A proposal must reach over the end mark, its tokens must stand alone, its pairs must agree.
        bad = counts == 0
        some = ~bad
        bad[some] |= last[first[1:][some] - 1] != ends_at[some] - 1
        unsure = np.unique(token[self.alone[token] == 0])
        if len(unsure):
            ids, off = self.merge_many([self.texts[t] for t in unsure.tolist()])
            self.alone[unsure] = np.where((np.diff(off) == 1) & (ids[off[:-1]] == unsure), 1, -1)
        np.logical_or.at(bad, piece[self.alone[token] < 0], True)
        inside = piece[1:] == piece[:-1]
        keys, place = np.unique((token[:-1] << 20 | token[1:])[inside], return_inverse=True)
        np.logical_or.at(bad, piece[1:][inside][~self._pair_verdicts(keys)[place]], True)
        if bad.any():
            which = np.flatnonzero(bad)
            special = np.array([pieces[k] in self.special for k in which.tolist()], dtype=bool)
            again, at = self.merge_many(["" if x else inner[k] for k, x in zip(which.tolist(), special.tolist(), strict=True)])
            sizes = counts.copy()
            sizes[which] = np.where(special, 1, np.diff(at))
            off = np.concatenate([[0], np.cumsum(sizes)])
            out = np.empty(off[-1], dtype=np.int64)
            good = ~bad[piece]
            out[(np.arange(len(token)) - first[piece] + off[piece])[good]] = token[good]
            redone = np.diff(at)
            out[np.arange(len(again)) - np.repeat(at[:-1] - off[which], redone)] = again
            for k in which[special].tolist():
                out[off[k]] = self.special[pieces[k]]
            return out.astype(np.uint32), off
        return token.astype(np.uint32), first

    def cut(self, text: str) -> list[str]:
        if "<|" in text and self.split_special:
            out: list[str] = []
            for part in self.split_special(text):
                out.extend([part] if part in self.special else self._cut(part))
            return out
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return self.pieces(text.lower())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint32, offsets) of texts."""
        every: list[str] = []
        counts = []
        for text in texts:
            cut = self.cut(text)
            counts.append(len(cut))
            every.extend(cut)
        if not every:
            return np.zeros(0, dtype=np.uint32), np.zeros(len(texts) + 1, dtype=np.int64)
        coded = pa.array(every, pa.string()).dictionary_encode()
        del every
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        ids, off = self.encode_pieces(coded.dictionary.to_pylist())
        sizes = np.diff(off)[which]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        out = ids[np.arange(upto[-1]) - np.repeat(upto[:-1] - off[which], sizes)]
        return out, upto[np.concatenate([[0], np.cumsum(counts)])]

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, offsets) of the decoded texts, each still with a space at its end where it has a token."""
        upto = np.concatenate([[0], np.cumsum(np.diff(self.token_at)[ids])])
        # Where each byte comes from, as running sums of steps: 1 inside a token, which has a byte at least.
        source = np.ones(upto[-1], dtype=np.int64)
        first = self.token_at[ids]
        source[upto[:-1]] = first
        source[upto[1:-1]] -= self.token_at[ids[:-1] + 1] - 1
        np.cumsum(source, out=source)
        return self.token_bytes[source], upto[off]


_made: dict[str, WordBpe] = {}


def _coder(shared) -> WordBpe:
    """One coder for each process and broadcast."""
    if shared.id not in _made:
        _made.clear()
        _made[shared.id] = WordBpe(shared.value)
    return _made[shared.id]


class _Spec:
    """The broadcast vocabulary with an id that closures can key on; its size is that of the file."""

    def __init__(self, spark, path: str | None):
        self.held = spark.sparkContext.broadcast(load(path))
        self.id = uuid.uuid4().hex

    @property
    def value(self):
        return self.held.value


def _texts(buf: np.ndarray, off: np.ndarray) -> list[str]:
    return [buf[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace") for k in range(len(off) - 1)]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every document."""
    spec = _Spec(docs.sparkSession, path)

    def run(batches):
        coder = _coder(spec)
        for batch in batches:
            for i, j, buf, off in text_slices(batch.column(1), SLICE):
                ids, at = coder.encode(_texts(buf, off))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32), pa.int32()))
                yield pa.record_batch([batch.column(0).slice(i, j - i), lists], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    spec = _Spec(encoded.sparkSession, path)

    def run(batches):
        coder = _coder(spec)
        for batch in batches:
            lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            data, at = coder.decode(lists.values.to_numpy(zero_copy_only=False).astype(np.int64)[off[0] : off[-1]], off - off[0])
            texts = [data[at[k] : max(at[k], at[k + 1] - 1)].tobytes().decode() for k in range(batch.num_rows)]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _digests(coder: WordBpe, batch: pa.RecordBatch):
    """What ``round_trip_digests`` returns, for the slices of a batch (doc_id, text)."""
    for i, j, buf, off in text_slices(batch.column(1), SLICE):
        ids, at = coder.encode(_texts(buf, off))
        data, upto = coder.decode(ids, at)
        digests = [hashlib.sha256(ids[at[k] : at[k + 1]].astype("<u4").tobytes()).hexdigest() for k in range(j - i)]
        decoded = [hashlib.sha256(data[upto[k] : max(upto[k], upto[k + 1] - 1)].tobytes()).hexdigest() for k in range(j - i)]
        yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array(np.diff(at), pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids, in one pass."""
    spec = _Spec(docs.sparkSession, path)

    def run(batches):
        coder = _coder(spec)
        for batch in batches:
            yield from _digests(coder, batch)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark, sf_dir) -> DataFrame:
    return round_trip_digests(documents(spark, sf_dir))
