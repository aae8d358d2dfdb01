"""Near-duplicate records: pairs of texts whose sets of word shingles are similar enough.

PartEnum signatures: texts are put into size bands, wide enough that similar sets lie in the
same or in adjacent bands. For a level (a band with the one below it) the shingle domain is
hashed into ``n1`` partitions, and the content of one partition is one signature: similar
sets differ in few elements, hence agree on whole partitions. ``n1`` and the number ``g`` of
enumerated partitions follow from the threshold: a pair that is just similar enough agrees on
no enumerated, non-empty partition with a probability of ``miss`` at most, more similar pairs
far less; where sets are too small for that, every shingle is a signature and nothing is
missed. Subsets of two and more partitions are not enumerated: at a similarity of 0.6 two sets of
150 shingles differ in 76 elements, and the enumeration that is certain to find them takes at
least 154 signatures a level, of one or two shingles each (see the README).

The texts are shuffled once, to be bucketed by id with their SimHash sketches; signatures are
made of the buckets, and whatever is asked of a text later (sketch, shingles) is joined there.
Pairs that share a signature are left out where their 128-bit sketches, and then their 512-bit
sketches, are too far apart, with the same bound; sets with single shingles as signatures have
no sketch. The rest are verified on their exact shingles. The texts of a signature that more
than ``cap`` have (boilerplate, large families) are compared in salted blocks spread over tasks,
by both sketches. No signature is left out. Texts with equal words are one class: ``similar_pairs``
gives the pairs of representatives and the membership.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrock.llm.words import WordHashes, mix, words
from quillrock.session import bucketed, persisted

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@lru_cache(maxsize=512)
def level_plan(level: int, threshold: float, miss: float) -> tuple[int, int]:
    """``(n1, g)`` of a level: sizes between ``r**(level-1)`` and ``r**(level+1)``, r = 1/threshold."""
    s = threshold**-level
    need = -math.log(miss)
    h, m = (1 - threshold) / (1 + threshold), threshold / (1 + threshold)
    least, most = (1 + threshold) * s, 2 * s / threshold
    n1 = max(1, int(0.7 * s))
    while n1 <= 20 * s + 20:
        p = min(math.exp(-h * x / n1) * (1 - math.exp(-m * x / n1)) for x in (least, most))
        if n1 * p >= need:
            return n1, math.ceil(need / p)
        n1 = math.ceil(n1 * 1.1) + 1
    return 0, 0


def shingle_sets(texts: list[str | None], memo: WordHashes, width: int = 3) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its runs of ``width`` words (3 at most)."""
    flat: list[str] = []
    counts = []
    for t in texts:
        w = words(t or "")
        flat += w
        counts.append(len(w))
    h = np.fromiter(map(memo.__getitem__, flat), np.uint64, len(flat))
    n = max(0, len(h) - width + 1)
    with np.errstate(over="ignore"):
        x = h[:n] * _A
        for k, c in zip(range(1, width), (_B, _C)):
            x = mix(x + h[k : n + k]) * c
        x = mix(x)
    out = []
    at = 0
    for c in counts:
        out.append(np.unique(x[at : at + c - width + 1]) if c >= width else np.zeros(0, np.uint64))
        at += c
    return out


#: Bits of the sketch of a set, in words of 64; the longer ones begin with the shorter.
SKETCH_WORDS, LONG_SKETCH_WORDS = 2, 8
#: Texts of a block of a signature that more than ``cap`` have.
HOT_BLOCK = 4096
#: Members of a class of equal texts whose pairs are listed in one place.
CLASS_BLOCK = 512


def sketches(sets: list[np.ndarray], words: int = SKETCH_WORDS) -> np.ndarray:
    """A SimHash of each set: ``len(sets) x words``."""
    size = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), words), np.uint64)
    some = np.flatnonzero(size)
    if not len(some):
        return out
    x = np.concatenate([sets[i] for i in some])
    start = np.cumsum(size[some]) - size[some]
    # votes are counted in the eight bytes of a number, in runs of 255 at most
    runs = -(-size[some] // 255)
    first = np.cumsum(runs) - runs
    begin = np.repeat(start - 255 * first, runs) + 255 * np.arange(runs.sum())
    for k in range(words):
        h = mix(x ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (1 << 64) - 1))
        votes = np.zeros((len(some), 8, 8), bool)
        for bit in range(8):
            lanes = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(0x0101010101010101), begin).view(np.uint8).reshape(-1, 8)
            votes[:, bit] = np.add.reduceat(lanes, first, axis=0, dtype=np.int32) * 2 > size[some][:, None]
        out[some, k] = np.packbits(votes.reshape(-1, 64), axis=1).view(np.uint64).ravel()
    return out


@lru_cache(maxsize=64)
def most_differing(threshold: float, miss: float, words: int = SKETCH_WORDS) -> int:
    """Bits in which the sketches of sets of at least this similarity differ, but for ``miss``:
    their angle is at most that of equal sizes."""
    cosine = 2 * threshold / (1 + threshold)
    p = math.acos(cosine) / math.pi
    n = 64 * words
    tail, k = 1.0, -1
    while tail > miss:
        k += 1
        tail -= math.comb(n, k) * p**k * (1 - p) ** (n - k)
    return k


def signatures(sets: list[np.ndarray], threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """``(position of the set, signature)`` of all sets, vectorised over them."""
    owner: list[np.ndarray] = []
    signs: list[np.ndarray] = []
    size = np.array([len(s) for s in sets])
    band = np.floor(np.log(np.maximum(size, 1)) / -math.log(threshold) + 1e-9).astype(int)
    for level_of in (0, 1):
        level = band + level_of
        plans = np.array([level_plan(int(x), threshold, miss) for x in level]).reshape(-1, 2)
        doc = np.repeat(np.arange(len(sets)), size)
        x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
        n1, g = plans[doc, 0].astype(np.uint64), plans[doc, 1].astype(np.uint64)
        salt = level[doc].astype(np.uint64) * _B
        single = n1 == 0
        if single.any() and level_of == 0:  # the shingle itself, the same for all levels
            owner.append(doc[single])
            signs.append(mix(x[single] ^ _C))
        part = ((x >> np.uint64(32)) * n1) >> np.uint64(32)
        keep = ~single & (part < g)
        doc, x, part, salt = doc[keep], x[keep], part[keep], salt[keep]
        order = np.argsort(doc.astype(np.int64) << 32 | part.astype(np.int64), kind="stable")
        doc, x, part, salt = doc[order], x[order], part[order], salt[order]
        if not len(doc):
            continue
        start = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])]))
        with np.errstate(over="ignore"):
            content = np.bitwise_xor.reduceat(mix(x), start)
            signs.append(mix(content + part[start] * _A + salt[start]))
        owner.append(doc[start])
    if not owner:
        return np.zeros(0, int), np.zeros(0, np.uint64)
    return np.concatenate(owner), np.concatenate(signs)


def unsketched(sets: list[np.ndarray], threshold: float, miss: float) -> np.ndarray:
    """Which sets are too small for the bound of the sketches: those whose shingles are the signatures."""
    band = np.floor(np.log([max(1, len(s)) for s in sets]) / -math.log(threshold) + 1e-9).astype(int)
    return np.array([level_plan(int(x), threshold, miss)[0] == 0 for x in band], bool)


def near_in_block(sketch: np.ndarray, differing: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions ``i < j`` of the columns of ``sketch`` (words x texts) that differ in at most so many
    bits, or of which one is all zeros: that stands for a set without a sketch."""
    without = ~sketch.any(0)
    for s in range(0, sketch.shape[1] - 1, 256):
        close = np.bitwise_count(sketch[:, s : s + 256, None] ^ sketch[:, None, s:]).sum(0) <= differing
        i, j = np.nonzero(close | without[s : s + 256, None] | without[s:] if without.any() else close)
        later = j > i
        yield i[later] + s, j[later] + s


def bucket_pairs(rows: DataFrame, key: str, cap: int, differing: int) -> DataFrame:
    """``(a, b, key)`` of the ids that share a ``key`` and whose sketches (``s0, s1``) differ in at most
    ``differing`` bits, of buckets of at most ``cap`` ids; larger buckets give ``(id, null, key)`` rows.

    Reads each partition as a sorted stream; a bucket holds at most ``cap`` rows, and their
    sketches are compared in blocks: only near pairs leave.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.uint64(2**64 - 1)
        open_key, hot = None, False
        held: list[np.ndarray] = []  # parts of the open bucket: id, two sketch words
        count = 0
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> None:
            if hot or count < 2:
                return
            v = np.concatenate(held, axis=1)
            v = v[:, np.unique(v[0], return_index=True)[1]]
            for i, j in near_in_block(v[1:3], differing):
                out.append((v[0, i], v[0, j], np.full(len(i), open_key)))

        def batch() -> pa.RecordBatch:
            a, b = (np.concatenate([o[k] for o in out]).view(np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=b == -1), pa.array(np.concatenate([o[2] for o in out]))], names=["a", "b", "key"])

        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False)
            cols = np.stack([b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(1, 4)])
            start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ends = np.append(start[1:], len(keys))
            busy = ends - start > 1
            busy[[0, -1]] = True
            for s, e in zip(start[busy].tolist(), ends[busy].tolist()):
                if keys[s] != open_key:
                    close()
                    open_key, held, count, hot = keys[s], [], 0, False
                held.append(cols[:, s:e])
                count += e - s
                if hot or count > cap:
                    hot = True
                    out += [(h[0], np.full(h.shape[1], none), np.full(h.shape[1], open_key)) for h in held]
                    held = []
            if out:
                yield batch()
                out.clear()
        close()
        if out:
            yield batch()

    placed = rows.repartition(F.col(key)).sortWithinPartitions(key).select(F.col(key).cast("bigint"), "id", "s0", "s1")
    return placed.mapInArrow(run, "a bigint, b bigint, key bigint")


def small(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """Slices of so many rows: what is computed of a batch takes many times its own memory."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _hot_pairs(hot: DataFrame, reps: DataFrame, tests: tuple[int, int]) -> DataFrame:
    """``a, b`` (a < b) of the texts of ``hot`` (``key, id``) that share a key, by their long sketches.

    The texts of a key are dealt into blocks of about ``HOT_BLOCK``, and every two blocks are
    compared in one place.
    """
    near, far = tests

    def compare(group: pa.Table) -> pa.Table:
        ids, at = np.unique(group.column("id").to_numpy(), return_index=True)
        block = group.column("block").to_numpy()[at]
        both = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        long = np.frombuffer(b"".join(group.column("sketch").take(pa.array(at)).to_pylist()), np.uint64).reshape(-1, LONG_SKETCH_WORDS).T
        found = [(np.zeros(0, np.int64),) * 2]
        for i, j in near_in_block(np.ascontiguousarray(long[:SKETCH_WORDS]), near):
            keep = (np.bitwise_count(long[:, i] ^ long[:, j]).sum(0) <= far) | ~long[:, i].any(0) | ~long[:, j].any(0)
            if both:  # pairs within one of the two blocks are compared elsewhere
                keep &= block[i] != block[j]
            found.append((ids[i[keep]], ids[j[keep]]))
        return pa.table({"a": np.concatenate([f[0] for f in found]), "b": np.concatenate([f[1] for f in found])})

    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / HOT_BLOCK).alias("blocks"))
    dealt = hot.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    placed = dealt.hint("merge").join(reps.select("id", "sketch"), "id").select("key", "id", "sketch", "block", other.alias("other"))
    placed = placed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "sketch", "block")
    return placed.groupBy("key", "i", "j").applyInArrow(compare, "a bigint, b bigint").distinct()


def similar_pairs(keyed: DataFrame, texts: DataFrame, threshold: float = 0.8, width: int = 3, miss: float = 1e-4, cap: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(pairs, classes)`` of ``texts`` (``id bigint, text string``).

    ``keyed`` has the ids that take part, with their ``word_key``. ``classes``: ``id, class`` with
    the smallest id of the texts of equal words; ``pairs``: ``a, b, similarity`` (a < b) of class
    representatives with a similarity of at least ``threshold``. Defined results: null texts and
    texts of fewer than ``width`` words take no part in pairs of different classes.
    """
    rep = keyed.groupBy("k1", "k2", "k3").agg(F.min("id").alias("class"))
    classes = persisted(keyed.join(rep, ["k1", "k2", "k3"]).select("id", "class"), "classes")
    near, far = tests = tuple(most_differing(threshold, miss / 2, w) for w in (SKETCH_WORDS, LONG_SKETCH_WORDS))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in small(batches):
            sets = shingle_sets(b.column(1).to_pylist(), memo, width)
            long = sketches(sets, LONG_SKETCH_WORDS)
            long[unsketched(sets, threshold, miss)] = 0
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in long], pa.binary())], names=["id", "text", "sketch"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in small(batches):
            owner, signs = signatures(shingle_sets(b.column(1).to_pylist(), memo, width), threshold, miss)
            long = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64).reshape(-1, LONG_SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signs.view(np.int64)), b.column(0).take(pa.array(owner)), pa.array(long[owner, 0]), pa.array(long[owner, 1])],
                names=["sign", "id", "s0", "s1"],
            )

    # the one shuffle of texts: later joins find the representatives in the buckets of their ids
    wanted = classes.where("id = class").select("id").distinct()
    reps = texts.select("id", "text").join(wanted.hint("merge"), "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    reps = bucketed(reps.mapInArrow(sketch, "id bigint, text string, sketch binary"), "representatives", "id")
    signed = reps.select("id", "text", "sketch").mapInArrow(sign, "sign bigint, id bigint, s0 bigint, s1 bigint")
    found = persisted(bucket_pairs(signed, "sign", cap, near), "candidates")
    candidates = found.where("b is not null").select("a", "b").distinct()
    candidates = _near_by_sketch(candidates, reps, far)
    hot = found.where("b is null").select("key", F.col("a").alias("id"))
    if not hot.isEmpty():
        candidates = candidates.unionByName(_hot_pairs(hot, reps, tests)).distinct()
    return verified(candidates, reps, threshold, width), classes


def _near_by_sketch(candidates: DataFrame, reps: DataFrame, far: int) -> DataFrame:
    """The candidates whose long sketches differ in at most ``far`` bits, or of which one has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint64).reshape(-1, LONG_SKETCH_WORDS) for i in (2, 3))
            near = (np.bitwise_count(x ^ y).sum(1) <= far) | ~x.any(1) | ~y.any(1)
            keep = pa.array(np.flatnonzero(near))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep)], names=["a", "b"])

    side = lambda i, t: reps.select(F.col("id").alias(i), F.col("sketch").alias(t))
    j = candidates.hint("merge").join(side("a", "x"), "a").hint("merge").join(side("b", "y"), "b")
    return j.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def verified(candidates: DataFrame, reps: DataFrame, threshold: float, width: int) -> DataFrame:
    """``a, b, similarity`` of the candidates whose exact shingle sets are similar enough.

    ``reps`` (``id, text``) is bucketed by id, so only the candidates move: to the text of one
    side, and with it to that of the other.
    """
    candidates = persisted(candidates, "pairs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for b in small(batches, 2_000):
            ids, at, texts = [], {}, []
            for i, t in ((0, 2), (1, 3)):
                ids.append(b.column(i).to_pylist())
                for x, text in zip(ids[-1], b.column(t).to_pylist()):
                    if x not in at:
                        at[x] = len(texts)
                        texts.append(text)
            sets = shingle_sets(texts, memo, width)
            out = np.zeros(b.num_rows)
            for k, (p, q) in enumerate(zip(*ids)):
                x, y = sets[at[p]], sets[at[q]]
                if threshold * max(len(x), len(y)) <= min(len(x), len(y)):
                    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                    out[k] = both / max(1, len(x) + len(y) - both)
            keep = pa.array(np.flatnonzero(out >= threshold - 1e-12))
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array(out).take(keep)], names=["a", "b", "similarity"])

    side = lambda i, t: reps.select(F.col("id").alias(i), F.col("text").alias(t))
    j = candidates.hint("merge").join(side("a", "x"), "a").hint("merge").join(side("b", "y"), "b")
    return j.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, similarity double")


def plain_words(text: Column) -> Column:
    """The words of a text in lower case, one blank between."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def word_key(df: DataFrame, text: Column) -> DataFrame:
    """Add ``k1, k2, k3``, equal for texts of equal words, and ``n_words``."""
    df = df.withColumn("__plain", plain_words(text))
    words_ = F.when(F.col("__plain") == "", 0).otherwise(F.length("__plain") - F.length(F.replace("__plain", F.lit(" "), F.lit(""))) + 1)
    return df.select("*", F.xxhash64("__plain").alias("k1"), F.xxhash64(F.lit(7), "__plain").alias("k2"), F.length("__plain").alias("k3"), words_.alias("n_words")).drop("__plain")


def text_of(subject: Column, body: Column) -> Column:
    """Subject, line feed, body; a null subject is empty."""
    return F.concat(F.coalesce(subject, F.lit("")), F.lit("\n"), body)


def similar_messages(messages: DataFrame, threshold: float = 0.6, width: int = 3) -> DataFrame:
    """``id_a, id_b`` (smaller first): canonical identifiers of messages with a non-empty body whose
    shingle sets have at least this similarity.

    Copies of a message are one (its smallest row id with a body). Messages without identifier
    take no part. Texts with equal words and at least one shingle are similar in full: pairs of
    a class are those of its members, found with its representative.
    """
    from quillrock.operators.deliveries import canonical_id

    rows = messages.where("body is not null and body <> ''").select("row_id", canonical_id("message_id").alias("cid"), text_of(F.col("subject"), F.col("body")).alias("text"))
    rows = rows.where("cid is not null")
    every = word_key(rows.select("cid", F.col("row_id").alias("id"), "text"), F.col("text")).drop("text")
    first = F.min_by(F.struct("k1", "k2", "k3", "n_words"), "id").alias("k")
    one = persisted(every.groupBy("cid").agg(F.min("id").alias("id"), first).select("cid", "id", "k.*"), "messageids")
    pairs, classes = similar_pairs(one, rows.select(F.col("row_id").alias("id"), "text"), threshold, width)
    named = classes.join(one.select("id", "cid", "n_words"), "id").select("class", "cid", "n_words")
    # members of a class are dealt into blocks; every two blocks meet in one place
    many = named.where(F.col("n_words") >= width).groupBy("class").agg(F.ceil(F.count("*") / CLASS_BLOCK).alias("blocks"), F.count("*").alias("n")).where("n > 1")
    dealt = named.join(many, "class").select("class", "cid", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("own"), F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1).alias("all"))
    inside = dealt.select("class", F.col("cid").alias("x"), F.col("own").alias("i"), F.explode("all").alias("j")).join(
        dealt.select("class", F.col("cid").alias("y"), F.explode("all").alias("i"), F.col("own").alias("j")), ["class", "i", "j"]
    ).where("x < y").select("x", "y")
    name = lambda c, x: named.select(F.col("class").alias(c), F.col("cid").alias(x))
    across = pairs.join(name("a", "x"), "a").join(name("b", "y"), "b").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
