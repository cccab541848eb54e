"""Near-duplicate detection: ProbMinHash of weighted shingles, banding, exact verification.

A text is a bag of shingles of five words, weighted by their counts. Every
shingle sends exponential arrivals, at a rate equal to its weight, to registers
drawn at random; a register keeps its earliest arrival. Arrivals come in order
of time for each shingle, so it stops as soon as its next one is later than
every register of the document (early termination). Two registers agree with
the probability Jaccard similarity of the bags. Registers are banded; documents
that share a band are candidates, and every candidate pair that counts is
verified by the exact similarity on its whole texts.

Copies are collapsed first, so a group of equal texts is one node. Of a
bucket's members, each is verified against the smallest one (no pairs within
the bucket). That may miss links between two members that are both far from it,
so buckets whose members are still in different components go through a second
round: pairs of different components are compared in blocks, without those that
the triangle inequality rules out (one minus the similarity is a metric) or whose
registers agree far too seldom, and the rest is verified. It goes by closeness:
each member's closest partner first, then bounds of ranks that grow eightfold until
no bucket holds two components or all its pairs had their turn, so a group that hangs together
through a few members does not verify all its pairs. Each class is a connected component
of verified links.

Defined cases: null text counts as empty; texts without words are similar only
to equal texts; a text of fewer than five words is one shingle; a row without id
is in no class (class_id null) and stays; rows that share an id and a text are one document (all stay or
all go), rows that share an id with different texts are documents of their own; in a class of tied ids the
text of the smallest digest stays; an empty table gives an empty result; other columns, of any name, are not
read. Texts may be of any length; one text is held in memory at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floeline.llm.flat import mix, prefix_hash, span_hash, text_slices, words
from floeline.llm.graph import components, joined
from floeline.llm.rows import digest, identified, keyed, of_texts
from floeline.llm.shared import BROADCAST_VALUES, Scratch, documents, fresh, gathered, light, release, settled, whole

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: The similarity is a sum of fractions in floating point: a pair at the threshold exactly may come out this much lower.
ROUNDING = 1e-9
#: Bands and registers of each: a pair at 0.8 is missed with probability (1 - 0.8**6)**32 = 6e-5.
BANDS, BAND_ROWS = 32, 6
REGISTERS = BANDS * BAND_ROWS
#: Further registers (of 8 bits) of the documents that go into the second round.
FINE = 1024
#: How far below the threshold the agreement may be for a pair to be verified, of the first registers and of all: over five standard deviations.
ESTIMATE_SLACK, FINE_SLACK = 0.15, 0.06
#: Members of a bucket that one block of the second round holds.
BLOCK = 1024
#: Pairs of one document that a block of verification holds.
STAR = 512
#: The second round takes pairs of ranks below 1, then 8, 64 and so on; links found at one bound spare the pairs of the next.
RANKS = 8


def shingles(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle, document, weight): the distinct shingles of each document, ordered by document and shingle."""
    with np.errstate(over="ignore"):
        s, e, doc = words(buf, off)
        if not len(s):
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0)
        word = span_hash(prefix_hash(buf), s, e, 11)
        per = np.bincount(doc, minlength=len(off) - 1)
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        # Where shingles begin: all places with enough words after them; the first place of a short text.
        left = per[doc] - (np.arange(len(doc)) - first[doc])
        begin = np.flatnonzero((left >= size) | ((per[doc] < size) & (left == per[doc])))
        have = np.minimum(left[begin], size)
        value = np.zeros(len(begin), dtype=np.uint64)
        for k in range(size):
            inner = have > k
            value[inner] = mix(value[inner] * np.uint64(31) + word[begin[inner] + k])
        owner = doc[begin]
        order = np.lexsort((value, owner))
        value, owner = value[order], owner[order]
        fresh = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]))
        return value[fresh], owner[fresh], np.diff(np.append(fresh, len(value))).astype(np.float64)


def registers(value: np.ndarray, owner: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS, seed: int = 0) -> np.ndarray:
    """n x m: the shingle whose arrival is the earliest at each register (0 for documents without shingles)."""
    best = np.full(n * m, np.inf)
    kept = np.zeros(n * m, dtype=np.uint64)
    time = np.zeros(len(value))
    turn = 0
    with np.errstate(over="ignore", divide="ignore"):
        while len(value):
            # Few shingles left: take several arrivals of each at once.
            many = int(min(64, max(1, 20_000 // len(value))))
            bits = mix(np.repeat(value, many) + (np.tile(np.arange(turn, turn + many, dtype=np.uint64), len(value)) * np.uint64(0x9E3779B97F4A7C15)), 77 + seed)
            turn += many
            unit = ((bits >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52
            gaps = (-np.log(unit) / np.repeat(weight, many)).reshape(-1, many)
            at_time = (time[:, None] + np.cumsum(gaps, axis=1)).ravel()
            # The register comes from a hash of its own.
            place = np.repeat(owner, many) * m + (mix(bits, 78) % np.uint64(m)).astype(np.int64)
            np.minimum.at(best, place, at_time)
            won = best[place] == at_time
            kept[place[won]] = np.repeat(value, many)[won]
            time = at_time.reshape(-1, many)[:, -1]
            latest = best.reshape(n, m).max(axis=1)
            go = time < latest[owner]
            value, owner, weight, time = value[go], owner[go], weight[go], time[go]
    return kept.reshape(n, m)


def bands(kept: np.ndarray) -> np.ndarray:
    """n x BANDS keys; the band's number is part of its key."""
    with np.errstate(over="ignore"):
        parts = kept.reshape(len(kept), BANDS, BAND_ROWS)
        key = np.tile(np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), (len(kept), 1))
        for k in range(BAND_ROWS):
            key = mix(key * np.uint64(31) + parts[:, :, k], 79)
        return key


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two bags (sorted shingles, weights).

    The sum over shared d of 1 / sum over d' of max(a(d')/a(d), b(d')/b(d)). Ordered by
    the ratio a/b, the inner maximum is a's term above d's ratio and b's below it.
    """
    union = np.union1d(a[0], b[0])
    wa, wb = np.zeros(len(union)), np.zeros(len(union))
    wa[np.searchsorted(union, a[0])] = a[1]
    wb[np.searchsorted(union, b[0])] = b[1]
    if not len(union):
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = wa / wb
    order = np.argsort(ratio, kind="stable")
    ra, sa, sb = ratio[order], wa[order], wb[order]
    below = np.concatenate([[0], np.cumsum(sb)])
    above = np.concatenate([[0], np.cumsum(sa)])
    shared = (sa > 0) & (sb > 0)
    at = np.searchsorted(ra, ra[shared], side="left")
    return float((1 / ((above[-1] - above[at]) / sa[shared] + below[at] / sb[shared])).sum())


def _sign(rows: DataFrame) -> DataFrame:
    """(id, bands, sketch); bands null for texts without words, the sketch holds 16 bits of each register."""

    def sign(batches):
        for batch in batches:
            for i, j, buf, off in text_slices(batch.column(1)):
                value, owner, weight = shingles(buf, off)
                n = j - i
                kept = registers(value, owner, weight, n)
                keys = bands(kept).view(np.int64).reshape(-1)
                sketch = (kept >> np.uint64(48)).astype(np.uint16)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(keys, pa.int64()))
                none = np.bincount(owner, minlength=n) == 0
                lists = pa.compute.if_else(pa.array(none), pa.scalar(None, lists.type), lists)
                yield pa.record_batch([batch.column(0).slice(i, n), lists, pa.array([x.tobytes() for x in sketch], pa.binary())], names=["id", "bands", "sketch"])

    return rows.select("id", "text").mapInArrow(sign, "id long, bands array<long>, sketch binary")


def _sign_finely(rows: DataFrame) -> DataFrame:
    """(node, fine): 8 bits of each of FINE further registers, of rows (id, text)."""

    def sign(batches):
        for batch in batches:
            for i, j, buf, off in text_slices(batch.column(1), 1 << 18):
                kept = registers(*shingles(buf, off), j - i, FINE, 100)
                yield pa.record_batch([batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in (kept >> np.uint64(56)).astype(np.uint8)], pa.binary())], names=["node", "fine"])

    return rows.select("id", "text").mapInArrow(sign, "node long, fine binary")


def verified(pairs: DataFrame, many: int, rows: DataFrame) -> DataFrame:
    """(a, b, sim) of the distinct pairs (a, b), settled, ``many`` in all, by the exact similarity of whole texts.

    The pairs of one ``a`` are dealt over blocks of ``STAR`` at most. A block gets the text of ``a`` once and
    that of each ``b``, ordered, and a task sees one after another, with the bag of ``a`` at hand.
    """
    blocks = settled(pairs.groupBy("a").count().filter(F.col("count") > STAR).select("a", F.ceil(F.col("count") / F.lit(float(STAR))).cast("int").alias("blocks")), many)
    dealt = pairs.join(light(blocks, many // STAR), "a", "left").select("a", "b", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("b"), F.col("blocks"))).cast("int").alias("block"))
    need = settled(dealt.select("a", "block", F.lit(1).alias("side"), F.col("b").alias("id")).union(dealt.select("a", "block", F.lit(0), "a").distinct()), 2 * many)
    sent = rows.join(light(need), "id").select("a", "block", "side", "id", "text")

    def compare(batches):
        at, bag, last = None, None, None
        for batch in batches:
            a, block, side, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            out, once = np.full(batch.num_rows, -1.0), side == 1
            for i, j, buf, off in text_slices(batch.column(4), 1 << 20):
                value, owner, weight = shingles(buf, off)
                edges = np.searchsorted(owner, np.arange(j - i + 1))
                for k in range(j - i):
                    own = value[edges[k] : edges[k + 1]], weight[edges[k] : edges[k + 1]]
                    if not side[i + k]:
                        at, bag = (a[i + k], block[i + k]), (own[0].copy(), own[1].copy())
                    elif last == (*at, ids[i + k]):
                        # Repeated rows give a pair more than once.
                        once[i + k] = False
                    else:
                        out[i + k], last = similarity(bag, own), (*at, ids[i + k])
            yield pa.record_batch([pa.array(a[once]), pa.array(ids[once]), pa.array(out[once])], names=["a", "b", "sim"])

    ordered = sent.repartition("a", "block").sortWithinPartitions("a", "block", "side", "id")
    return ordered.mapInArrow(compare, "a long, b long, sim double")


def linked(sims: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the verified pairs that are as similar as ``threshold`` or more."""
    return sims.filter(F.col("sim") >= threshold - ROUNDING).select("a", "b")


def _cross_pairs(entries: DataFrame, threshold: float, ranks: int) -> DataFrame:
    """(a, b, bucket): pairs of a bucket's members in different components that may be similar, the closest first.

    Rows: bucket, band, node, comp, bands, sketch, fine, dist (to the bucket's smallest member), and of the bucket
    major (its largest component), large (the members of it) and others (all other members). Members of the largest
    component are never compared with each other: it and the others are cut into blocks apart, and a task gets a block
    of others with another block of either kind, so no task sees more than two blocks' members at once. A pair's rank
    is its place among the pairs of either member there (of the one that is not in the largest component, if the
    other is), the most agreeing registers first; pairs of a rank below ``ranks`` are given, with a null bucket.
    Rows with a bucket name its members (a and b are equal) that have pairs of further ranks.
    """
    agree = threshold - ESTIMATE_SLACK
    cut = lambda c: F.ceil(F.col(c) / F.lit(float(BLOCK))).cast("int")
    inside = F.col("comp") == F.col("major")
    dealt = entries.withColumn("few", cut("others")).withColumn("many", cut("large"))
    dealt = dealt.withColumn("own", F.when(inside, F.col("few") + F.pmod(F.xxhash64("node"), F.col("many"))).otherwise(F.pmod(F.xxhash64("node"), F.col("few"))).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "few", "node", "comp", "dist", F.slice("bands", 1, F.col("band") + 1).alias("bands"), "sketch", "fine", "band")

    def places(score: np.ndarray) -> np.ndarray:
        """The place of each column in its row, the largest score first."""
        order = np.argsort(-score, axis=1, kind="stable")
        out = np.empty_like(order)
        np.put_along_axis(out, order, np.broadcast_to(np.arange(score.shape[1]), score.shape), axis=1)
        return out

    def pairs(table: pa.Table) -> pa.Table:
        # By node: equal scores are always ranked alike.
        table = table.sort_by("node")
        node, comp, dist, own = (table.column(c).to_numpy() for c in ("node", "comp", "dist", "own"))
        i, j, few = (table.column(c)[0].as_py() for c in ("i", "j", "few"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if comp.min() == comp.max() or not len(left) or not len(right):
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "bucket")})
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
        fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), dtype=np.uint8).reshape(-1, FINE)
        band = table.column("band")[0].as_py()
        # The keys up to this band.
        keys = table.column("bands").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        score = np.full((len(left), len(right)), -1, dtype=np.int16)
        for at, x in enumerate(left):
            same = sketch[right] == sketch[x]
            # A pair that shares several bands is compared in the bucket of the first; whole keys, as sketches may agree by chance.
            lead = (keys[right] == keys[x]).argmax(axis=1) == band
            total = same.sum(axis=1)
            go = np.flatnonzero(lead & (total >= agree * REGISTERS) & (np.abs(dist[right] - dist[x]) <= 1 - threshold + ROUNDING) & (node[right] != node[x]))
            total = total[go] + np.count_nonzero(fine[right[go]] == fine[x], axis=1)
            near = total >= (threshold - FINE_SLACK) * (REGISTERS + FINE)
            score[at, go[near]] = total[near]
        rank = places(score)
        if j < few:
            rank = np.minimum(rank, places(score.T).T)
        take = (score >= 0) & (comp[left][:, None] != comp[right])
        if i == j:
            take &= node[left][:, None] < node[right]
        p, q = np.nonzero(take & (rank < ranks))
        x, y = node[left[p]], node[right[q]]
        further = take & (rank >= ranks)
        later = np.unique(np.concatenate([node[left[further.any(axis=1)]], node[right[further.any(axis=0)]]]))
        a, b = np.concatenate([np.minimum(x, y), later]), np.concatenate([np.maximum(x, y), later])
        none = np.arange(len(a)) < len(x)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "bucket": pa.array(np.full(len(a), table.column("bucket")[0].as_py()), pa.int64(), mask=none)})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(pairs, "a long, b long, bucket long")


def _mixed(member: DataFrame) -> DataFrame:
    """(bucket, major, large, others) of the buckets whose members (bucket, node, comp) are in several components."""
    sizes = member.groupBy("bucket", "comp").count().groupBy("bucket").agg(F.max(F.struct("count", "comp")).alias("top"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("count").alias("all"))
    return sizes.filter("lo != hi").select("bucket", F.col("top.comp").alias("major"), F.col("top.count").alias("large"), (F.col("all") - F.col("top.count")).alias("others"))


def _classes(rows: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
    """(id, class): every row (id, text) whose class is not its own id alone; ids are of distinct texts or repeated rows.

    ``keys``: their (id, sha).
    """
    spark = rows.sparkSession
    release(spark)
    scratch = Scratch(spark, "near")
    # Equal texts are one node, the smallest id; few enough copies are taken out where the texts are read.
    equal, many = gathered(keys.groupBy("sha").agg(F.min("id").alias("node"), F.max("id").alias("most")).filter("node != most").select("sha", "node"))
    copies, many = gathered(keys.join(light(equal, many), "sha").filter("id != node").select("id", "node"))
    once = rows.join(F.broadcast(copies.select("id")), "id", "left_anti") if 2 * many <= BROADCAST_VALUES else rows
    signed = scratch.written(_sign(once))
    # Beyond that, signatures are sorted out instead of texts.
    signed = signed if once is not rows else scratch.written(signed.join(copies.select("id"), "id", "left_anti"))
    banded = signed.filter("bands IS NOT NULL").select(F.col("id").alias("node"), F.posexplode("bands").alias("band", "bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("node").alias("rep"), F.max("node").alias("most")).filter("rep != most").drop("most")
    entries = settled(banded.join(buckets, "bucket"))
    stars, many = gathered(entries.filter("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct())
    first, _ = gathered(verified(stars, many, rows))
    comps = components(linked(first, threshold), many)
    # Second round: the buckets that still hold several components, their closest pairs first.
    sims = first.select(F.col("a").alias("rep"), F.col("b").alias("node"), "sim")
    member = entries.join(light(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed, much = gathered(member.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("bucket"))
    rest = entries.join(light(mixed, much), "bucket").join(light(sims, many), ["rep", "node"], "left")
    rest, left = gathered(rest.select("bucket", "band", "node", F.when(F.col("node") == F.col("rep"), 0.0).otherwise(1 - F.coalesce("sim", F.lit(0.0))).alias("dist")))
    # What this round needs of its documents is read from tables of theirs alone.
    nodes = settled(rest.select(F.col("node").alias("id")).distinct(), left)
    of_nodes = light(nodes)
    texts = scratch.written(rows.join(of_nodes, "id", "left_semi"))
    sketches = signed.join(of_nodes, "id", "left_semi").withColumnRenamed("id", "node")
    sketches = settled(sketches.join(_sign_finely(texts).dropDuplicates(["node"]), "node"))
    # Ranks follow the components, so all pairs below the next bound are asked for, but those verified before.
    tried, ranks = stars, 1
    while True:
        release(spark)
        member = rest.join(light(comps), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = settled(_mixed(member), left)
        if not (much := mixed.count()):
            break
        found, much = gathered(_cross_pairs(member.join(light(mixed, much), "bucket").join(sketches, "node"), threshold, ranks))
        pairs = settled(found.filter("bucket IS NULL").select("a", "b").distinct().join(light(tried, many), ["a", "b"], "left_anti"), much)
        if new := pairs.count():
            links, _ = gathered(linked(verified(pairs, new, texts), threshold))
            comps, tried, many = joined(comps, links, new), tried.union(pairs), many + new
        # Only members with pairs of further ranks go on.
        further = found.filter("bucket IS NOT NULL").select("bucket", F.col("a").alias("node"))
        rest, ranks = settled(rest.join(light(further), ["bucket", "node"], "left_semi"), left), ranks * RANKS
        left = rest.count()
    scratch.close()
    named = copies.join(light(comps), "node", "left").select("id", F.coalesce("comp", "node").alias("class"))
    return named.union(comps.select(F.col("node").alias("id"), F.col("comp").alias("class")))


def _verdicts(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(ids of the rows that have one, their classes, names of ids); see ``identified``."""
    rows = of_texts(docs, id_col, text_col).filter("id IS NOT NULL")
    rows, keys, names = identified(rows, keyed(rows))
    return keys.select("id"), gathered(_classes(rows, keys, threshold))[0], names


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id of its class)."""
    ids, classes, names = _verdicts(docs, threshold, id_col, text_col)
    found = ids.join(light(classes), "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class", "id").alias("class_id"))
    if names is not None:
        back = lambda c: light(names.select(F.col("number").alias(c), F.col("id").alias(f"{c}_own")))
        found = found.join(back("doc_id"), "doc_id").join(back("class_id"), "class_id").select(F.col("doc_id_own").alias("doc_id"), F.col("class_id_own").alias("class_id"))
    nameless = docs.filter(F.col(id_col).cast("long").isNull()).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"))
    return found.union(nameless)


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one document of each class stays: the smallest id."""
    _, classes, names = _verdicts(docs, SIMILARITY, id_col, text_col)
    gone, (own, sha) = classes.filter("id != class").select("id"), fresh("id", "sha")
    same = docs[id_col].cast("long") == F.col(own)
    if names is None:
        return docs.join(light(settled(gone.withColumnRenamed("id", own))), same, "left_anti")
    gone = names.join(gone, names["number"] == gone["id"], "left_semi").select(F.col("id").alias(own), F.col("sha").alias(sha))
    return docs.join(light(settled(gone)), same & (digest(whole(docs[text_col])) == F.col(sha)), "left_anti")


def op6_near_dedup(spark, sf_dir) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
