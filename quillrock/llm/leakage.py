"""Evaluation texts inside training text: which documents contain which test items.

Every shard of the corpus (the documents of a task, up to a number of words) gets an FM-index
over its words: the Burrows-Wheeler transform in a wavelet matrix of bits with running counts,
the first column, and the positions of every ``SAMPLED``-th word. The indexes are built once
and written to the shared folder, a row per shard; any set of test items is then searched for
in them. A phrase of ``n`` words is searched backwards, all phrases of a shard at once, and an
occurrence is located by walking back to the next sampled position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrock.llm.words import WordHashes, words
from quillrock.session import persisted

#: Words of a shard's index, about; a document lies in one shard as a whole.
SHARD_WORDS = 2_000_000
#: Test items searched for at once, about; more are searched in blocks.
ITEMS_PER_BLOCK = 20_000
#: Every so many words a position is kept.
SAMPLED = 32


class Bits:
    """A sequence of bits in words of 64, with the number of ones before each."""

    def __init__(self, words_: np.ndarray, before: np.ndarray):
        self.words, self.before = words_, before

    @staticmethod
    def of(bit: np.ndarray) -> Bits:
        packed = np.packbits(np.concatenate([bit.astype(bool), np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
        before = np.zeros(len(packed) + 1, np.int32)
        np.cumsum(np.bitwise_count(packed), out=before[1:])
        return Bits(packed, before[:-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks and values of a sequence of small integers, one bit level at a time."""

    def __init__(self, levels: list[tuple[Bits, int]]):
        self.levels = levels

    @staticmethod
    def of(seq: np.ndarray, bits: int) -> WaveletMatrix:
        levels = []
        for k in range(bits - 1, -1, -1):
            bit = (seq >> k & 1).astype(bool)
            levels.append((Bits.of(bit), int(len(seq) - bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])
        return WaveletMatrix(levels)

    def rank(self, c: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """How often ``c`` stands before ``pos``; both are arrays."""
        lo, hi = np.zeros(len(c), np.int64), pos.astype(np.int64)
        for k, (bits, zeros) in zip(range(len(self.levels) - 1, -1, -1), self.levels):
            up = (c >> k & 1).astype(bool)
            lo1, hi1 = bits.rank(lo), bits.rank(hi)
            lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        return hi - lo

    def value_and_rank(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value at each place, and how often it stands before it."""
        at, start, value = pos.astype(np.int64), np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
        for bits, zeros in self.levels:
            up = bits.get(at)
            value = value << 1 | up
            at1, start1 = bits.rank(at), bits.rank(start)
            at, start = np.where(up, zeros + at1, at - at1), np.where(up, zeros + start1, start - start1)
        return value, at - start


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Positions in the order of their suffixes; symbol 0 ends a document, and of two ends the earlier
    one is smaller. By doubling, where only suffixes still equal to others are sorted again."""
    n = len(seq)
    first = np.concatenate([[0], np.cumsum(np.bincount(seq))])
    rank = first[seq]
    rank[seq == 0] = np.arange(first[1])
    suffixes, width = np.argsort(rank, kind="stable"), 1
    while True:
        ordered = rank[suffixes]
        equal = np.zeros(n + 1, bool)
        equal[1:-1] = ordered[1:] == ordered[:-1]
        slots = np.flatnonzero(equal[:-1] | equal[1:])
        if not len(slots):
            return suffixes
        at = suffixes[slots]
        key = ordered[slots] * n + rank[at + width]
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        begins = np.concatenate([[True], key[1:] != key[:-1]])
        suffixes[slots] = at
        rank[at] = slots[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
        width *= 2


class FMIndex:
    """Places of phrases in a sequence; symbol 0 ends each document of it."""

    def __init__(self, starts: np.ndarray, bwt: WaveletMatrix, marked: Bits, kept: np.ndarray):
        self.starts, self.bwt, self.marked, self.kept = starts, bwt, marked, kept

    @staticmethod
    def of(seq: np.ndarray, symbols: int) -> FMIndex:
        suffixes = suffix_order(seq)
        before = seq[suffixes - 1]
        mark = (suffixes % SAMPLED == 0) | (before == 0)  # the walk back ends where a document begins
        bwt = WaveletMatrix.of(before.astype(np.int64), max(1, int(symbols - 1).bit_length()))
        return FMIndex(np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))]), bwt, Bits.of(mark), suffixes[mark].astype(np.int64))

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each phrase (rows of equal length), by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.starts[-1], np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            lo[live] = self.starts[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.starts[c] + self.bwt.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The position of each suffix, by walking back to the next sampled one."""
        out = np.zeros(len(rows), np.int64)
        at, steps, left = rows.astype(np.int64), 0, np.arange(len(rows))
        while len(left):
            known = self.marked.get(at)
            out[left[known]] = self.kept[self.marked.rank(at[known])] + steps
            left, at = left[~known], at[~known]
            if len(left):
                c, before = self.bwt.value_and_rank(at)
                at, steps = self.starts[c] + before, steps + 1
        return out


_INDEX = (
    "docs array<bigint>, lengths array<int>, vocabulary binary, starts binary, marks binary, marks_before binary, kept binary, levels array<struct<words:binary,before:binary,zeros:bigint>>"
)


def index_shards(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per shard of ``doc_id, text``, written to the shared folder: its index, documents and
    vocabulary (sorted hashes of words). It serves searches of phrases of any length."""

    def build(ids: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
        lengths = np.array([len(h) for h in hashes], np.int64)
        vocabulary, symbol = np.unique(np.concatenate(hashes), return_inverse=True)
        seq = np.zeros(int(lengths.sum()) + len(lengths), np.int64)
        place = np.arange(int(lengths.sum())) + np.repeat(np.arange(len(lengths)), lengths)
        seq[place] = symbol + 1
        fm = FMIndex.of(seq, len(vocabulary) + 1)
        levels = [{"words": b.words.tobytes(), "before": b.before.tobytes(), "zeros": z} for b, z in fm.bwt.levels]
        row = {
            "docs": ids, "lengths": lengths.tolist(), "vocabulary": vocabulary.tobytes(), "starts": fm.starts.astype(np.int64).tobytes(), "marks": fm.marked.words.tobytes(),
            "marks_before": fm.marked.before.tobytes(), "kept": fm.kept.tobytes(), "levels": levels,
        }
        kinds = {"docs": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "levels": pa.list_(pa.struct([("words", pa.binary()), ("before", pa.binary()), ("zeros", pa.int64())]))}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.binary())) for k, v in row.items()], names=list(row))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        ids, hashes, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text) if text else ()
                if doc_id is None or not w:
                    continue
                ids.append(doc_id)
                hashes.append(np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)))
                held += len(w)
                if held >= SHARD_WORDS:
                    yield build(ids, hashes)
                    ids, hashes, held = [], [], 0
        if ids:
            yield build(ids, hashes)

    return persisted(docs.select("doc_id", text_col).mapInArrow(run, _INDEX), "fmindex")


def _opened(row: dict) -> tuple[FMIndex, np.ndarray]:
    load = lambda b, t: np.frombuffer(b, t)
    levels = [(Bits(load(x["words"], np.uint64), load(x["before"], np.int32)), x["zeros"]) for x in row["levels"]]
    marked = Bits(load(row["marks"], np.uint64), load(row["marks_before"], np.int32))
    return FMIndex(load(row["starts"], np.int64), WaveletMatrix(levels), marked, load(row["kept"], np.int64)), load(row["vocabulary"], np.uint64)


class Phrases:
    """The distinct ``n``-word phrases of a block of items, as hashes of words."""

    def __init__(self, items: list[tuple], n: int):
        memo = WordHashes()
        self.items = [i for i, _ in items]
        grams: dict[bytes, list[int]] = {}
        for k, (_, text) in enumerate(items):
            w = np.array([memo[x] for x in words(text or "")], np.uint64)
            for i in range(len(w) - n + 1):
                owners = grams.setdefault(w[i : i + n].tobytes(), [])
                if not owners or owners[-1] != k:
                    owners.append(k)
        self.hashes = np.frombuffer(b"".join(grams), np.uint64).reshape(-1, n)
        self.owners = list(grams.values())


def _occurrences(p: Phrases, fm: FMIndex, vocabulary: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """``(document, phrase, word offset)`` of every occurrence in a shard."""
    if not len(vocabulary) or not len(p.hashes):
        return
    at = np.minimum(np.searchsorted(vocabulary, p.hashes), len(vocabulary) - 1)
    known = np.flatnonzero((vocabulary[at] == p.hashes).all(1))
    lo, hi = fm.search(at[known] + 1)
    count = hi - lo
    rows = np.repeat(lo, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    begin = np.cumsum(lengths + 1) - lengths - 1
    place = fm.locate(rows)
    doc = np.searchsorted(begin, place, "right") - 1
    yield from zip(doc.tolist(), np.repeat(known, count).tolist(), (place - begin[doc]).tolist())


def search_shards(index: DataFrame, items: DataFrame, n: int = 10, item_text: str = "passage") -> DataFrame:
    """``(doc_id, item_id, word_start, word_end)``: the merged runs of words of a document that stand in
    an item's text, each at least ``n`` words long."""
    named = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("text is not null").distinct()
    blocks = max(1, -(-named.count() // ITEMS_PER_BLOCK))
    block = named.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("item_id", "text"))).alias("items"))
    block = persisted(block.drop("block"), "itemblocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, p = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                own = [(x["item_id"], x["text"]) for x in row["items"]]
                if own != last:
                    last, p = own, Phrases(own, n)
                found: dict[tuple[int, int], list[int]] = {}
                for d, k, at in _occurrences(p, *_opened(row), np.array(row["lengths"], np.int64)):
                    for o in p.owners[k]:
                        found.setdefault((d, p.items[o]), []).append(at)
                rows = []
                for (d, item), at in found.items():
                    at.sort()
                    s = e = at[0]
                    for x in at[1:]:
                        if x > e + n:
                            rows.append((row["docs"][d], item, s, e + n))
                            s = x
                        e = x
                    rows.append((row["docs"][d], item, s, e + n))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "word_start", "word_end"]
                    )

    # every shard meets every block of the stated items; a block has a bounded number of them
    return index.crossJoin(block).mapInArrow(run, "doc_id bigint, item_id bigint, word_start int, word_end int")


def leaked_spans(docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text", item_text: str = "passage") -> DataFrame:
    """``search_shards`` over a fresh index of ``docs``.

    Defined results: null, empty and short texts hold nothing; items with fewer than ``n`` words
    are never found; an item that stands twice is found as one; a repeated document comes out
    as often as it stands, one without an id never.
    """
    return search_shards(index_shards(docs, text_col), items, n, item_text)


def leaked_items(docs: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """``(doc_id, item_id)``, each pair once."""
    return leaked_spans(docs, items, n).select("doc_id", "item_id").distinct()
