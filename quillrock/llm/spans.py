"""Long exact spans shared between records: how many characters of a text stand elsewhere.

The unit of comparison is the paragraph of fixed length: every window of ``span`` characters
of a text, each with a MinHash, the smallest hash of its ``gram``-character shingles. Equal
windows have equal MinHashes at equal offsets, so one band of one MinHash has full recall, and
neighbouring windows share theirs: a text has about one run of windows (an anchor) per half
window. Anchors whose MinHash stands in one text only are done. Runs of windows whose whole
text is equal are one class, shared in full if it lies in two texts. What is left are runs at
the edges of shared spans. A window holds half its length of text before or behind its anchor,
so a run whose text of that length on neither side stands at the same anchor in another text
shares nothing; of the others every window on that side is compared by its own hash. The
shared windows of a text are merged into the components that would be removed.

Natural paragraphs cannot give exact spans (a span may cross them or lie inside one), hence
the windows. Every grouping is a sorted stream over a hash partition. Groups that many texts
share are known beforehand from a sample of the texts: two texts of the sample with the same
run, or the same window, prove it shared, so its rows need no group at all, and the other runs
of a MinHash that two texts of the sample share are spread by their own hash. The sample only
places rows; the result is the same for any sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrock.llm.words import mix
from quillrock.session import persisted

_BASE = np.uint64(0xD6E8FEB86659FD93)
_POS_BITS = 20
#: Code points hashed at once; longer texts are taken in overlapping pieces.
BLOCK = 1 << 18
#: One text in so many is looked at for frequent groups, of at least so many texts there; at most so
#: many groups are kept (and broadcast): those beyond hold a small part of the rows each.
SAMPLED, FREQUENT, KEPT_GROUPS = 64, 8, 20_000
#: A place is packed with the number of windows that begin there, one after the other.
_MANY = 20
_COUNT = (1 << _MANY - 1) - 1
_KNOWN_SHARED = 1 << _MANY - 1
_RUN_SHARED, _MINHASH_SHARED = 1 << 40, 1 << 41


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b)]), dtype=np.uint64) for b in (base, inverse))


_KNOWN: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Rolling:
    """Hashes of all substrings of a run of code points, equal for equal substrings."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        size = 1 << max(16, int(n).bit_length())
        if size not in _KNOWN:
            _KNOWN[size] = _powers(_BASE, size)
        self.up, self.down = _KNOWN[size]
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    def fixed(self, length: int) -> np.ndarray:
        """Of every substring of ``length``."""
        n = len(self.sums) - length
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:n]) * self.down[:n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` consecutive values, by minima of blocks from both sides."""
    n = len(x)
    big = np.concatenate([x, np.full((-n) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(big, axis=1).ravel()
    right = np.minimum.accumulate(big[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _blocks(texts: list[str | None], span: int, block: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Concatenations of texts with ``(row, offset in its text, length)`` of each piece; a long text
    comes in pieces that overlap by ``span - 1``, so that each of its windows lies in one piece."""
    held: list[tuple[int, int, int]] = []
    parts: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        if text is None or len(text) < span:
            continue
        for at in range(0, len(text) - span + 1, block - span + 1):
            part = text[at : at + block]
            if size and size + len(part) > block:
                yield "".join(parts), held
                held, parts, size = [], [], 0
            held.append((row, at, len(part)))
            parts.append(part)
            size += len(part)
    if parts:
        yield "".join(parts), held


def window_runs(texts: list[str | None], span: int, gram: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, ...]]:
    """``(row, MinHash, hash of the run, offset of the first window, distance from there to the
    MinHash's position, number of windows, number with the repeats that follow, hashes of the text
    before and behind the MinHash)`` of all runs of windows."""
    w = span - gram + 1
    low = np.uint64((1 << _POS_BITS) - 1)
    for text, pieces in _blocks(texts, span, block):
        rolling = Rolling(codes_of(text))
        h = rolling.fixed(gram)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        anchor = (_sliding_min(key, w) & low).astype(np.int64)
        begin = np.cumsum([0] + [n for _, _, n in pieces])[:-1]
        count = np.array([n - span + 1 for _, _, n in pieces])
        piece = np.repeat(np.arange(len(pieces)), count)
        window = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
        chosen = anchor[window]
        first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (piece[1:] != piece[:-1])]))
        last = np.append(first[1:], len(window)) - 1
        a, b, p, k = window[first], window[last], chosen[first], piece[first]
        head, whole, low_at, n = h[p], rolling.of(a, b + span), p - a, b - a + 1
        # the text of half a window before and behind the anchor, where a window of the run holds it
        half = (span - gram) // 2
        before, behind = np.minimum(np.maximum(low_at - half + 1, 0), n) > 0, low_at - half + 1 < n
        with np.errstate(over="ignore"):
            left = mix(head * _BASE + np.where(before, rolling.of(np.maximum(p - half, 0), p), 0))
            right = mix(mix(head) * _BASE + np.where(behind, rolling.of(p + gram, np.minimum(p + gram + half, len(text))), 0))
        # equal runs one after the other (a text that repeats itself) are one, of so many windows
        same = (head[1:] == head[:-1]) & (whole[1:] == whole[:-1]) & (n[1:] == n[:-1]) & (low_at[1:] == low_at[:-1]) & (k[1:] == k[:-1])
        one = np.flatnonzero(np.concatenate([[True], ~same]))
        total = np.add.reduceat(n, one)
        a, k = a[one], k[one]
        rows = np.array([r for r, _, _ in pieces])[k]
        offset = a - begin[k] + np.array([o for _, o, _ in pieces])[k]
        yield rows, head[one], whole[one], offset, low_at[one], n[one], total, left[one], right[one]


#: What a run is: to be compared window by window, shared whole, or (besides) a partner to compare with.
EDGE, WHOLE, PARTNER = 0, 1, 2


#: Rows of runs: the number of windows ``n`` from ``at`` on; of each of them ``before`` hold the text
#: hashed as ``left``, the others that hashed as ``right``.
_FOUND = "doc bigint, at bigint, n bigint, kind int, extent bigint, left bigint, right bigint"


def _classified(runs: DataFrame) -> DataFrame:
    """The runs that may be shared, with their ``kind``.

    Two members of each shared class are partners where its MinHash has edges too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fp = cls = fp_doc = cls_doc = None
        fp_multi = cls_multi = has_edges = False
        waiting: list[tuple] = []  # single-document classes of a MinHash that stands in one document so far
        members: list[tuple] = []  # rows of a class that stands in one document so far
        partners: list[tuple] = []  # of the shared classes of a MinHash without edges so far
        out: list[tuple] = []

        def edges(rows: list[tuple]) -> None:
            nonlocal has_edges, partners
            if rows:
                out.extend((*m, EDGE) for m in rows)
                out.extend((*m, PARTNER) for m in partners)
                partners, has_edges = [], True

        def batch() -> pa.RecordBatch:
            doc, at, extent, left, right, kind = (np.array(x, np.int64) for x in zip(*out))
            columns = (doc, at >> _MANY, at & _COUNT, kind.astype(np.int32), extent, left, right)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc", "at", "n", "kind", "extent", "left", "right"])

        for b in batches:
            f, extent = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            start = np.concatenate([[True], f[1:] != f[:-1]])
            alone = start & np.append(start[1:], False)
            alone[0] = False
            known = extent & _RUN_SHARED != 0
            if known.any():
                extent_, doc, at, left, right = (b.column(i).to_numpy(zero_copy_only=False)[known] for i in range(2, 7))
                columns = (doc, at >> _MANY, at & _COUNT, np.full(len(doc), WHOLE, np.int32), extent_, left, right)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc", "at", "n", "kind", "extent", "left", "right"])
            ahead = pa.array(np.flatnonzero(~known & (~alone | (extent & _MINHASH_SHARED != 0))))
            for k, c, e, doc, at, left, right in zip(*(b.column(i).take(ahead).to_pylist() for i in range(7))):
                if k != fp or (c, e) != cls:
                    if fp_multi:
                        edges(members)
                    else:
                        waiting += members
                    members, cls, cls_doc, cls_multi = [], (c, e), doc, False
                    if k != fp:
                        fp, fp_doc, waiting, partners = k, doc, [], []
                        fp_multi = has_edges = bool(e & _MINHASH_SHARED)
                if not fp_multi and doc != fp_doc:
                    fp_multi = True
                    edges(waiting)
                    waiting = []
                own = (doc, at, e, left, right)
                if not cls_multi and doc != cls_doc:
                    cls_multi = True
                    out.extend((*m, WHOLE) for m in members)
                    two = [members[0], own]
                    if has_edges:
                        out.extend((*m, PARTNER) for m in two)
                    else:
                        partners += two
                    members = []
                if cls_multi:
                    out.append((*own, WHOLE))
                else:
                    members.append(own)
            if out:
                yield batch()
                out.clear()
        if fp_multi:
            edges(members)
        if out:
            yield batch()

    order = ["fp", "cls", "extent", "doc"]
    return runs.repartition("fp").sortWithinPartitions(*order).select(*order, "at", "left", "right").mapInArrow(run, _FOUND)


def _in_two(windows: DataFrame) -> DataFrame:
    """``doc, at, n`` of the windows whose hash stands in two documents (``n`` from ``at`` on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = doc0 = None
        multi, held = False, []
        for b in batches:
            h, d, a = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            known = a & _KNOWN_SHARED != 0
            out_d, out_a = [d[known]], [a[known]]
            h, d, a = h[~known], d[~known], a[~known]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            end = np.append(start[1:], len(h))
            for s, e in zip(start, end):
                if h[s] != key:
                    key, doc0, multi, held = h[s], d[s], False, []
                if not multi and (d[s:e] != doc0).any():
                    multi = True
                    for x, y in held:
                        out_d.append(x)
                        out_a.append(y)
                    held = []
                if multi:
                    out_d.append(d[s:e])
                    out_a.append(a[s:e])
                else:
                    held.append((d[s:e], a[s:e]))
            at = np.concatenate(out_a)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_d)), pa.array(at >> _MANY), pa.array(at & _COUNT)], names=["doc", "at", "n"])

    return windows.repartition("h").sortWithinPartitions("h").select("h", "doc", "at").mapInArrow(run, "doc bigint, at bigint, n bigint")


def _member(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` stand in the sorted ``known``."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def _spread(x: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(x ^ mix(doc.astype(np.uint64) * _BASE + at.astype(np.uint64)))


class Frequent:
    """Runs and MinHashes that two texts of the sample share: sorted hashes, each of bounded length."""

    def __init__(self, runs: list[int], minhashes: list[int]):
        self.runs, self.minhashes = (np.sort(np.array(x, np.int64).view(np.uint64)) for x in (runs, minhashes))

    def placed(self, fp: np.ndarray, cls: np.ndarray, extent: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``fp, extent`` of runs, so that those of a frequent group are spread, and marked."""
        fp, extent = fp.copy(), extent.copy()
        key = run_key(fp, cls, extent)
        run, minhash = _member(key, self.runs), _member(fp, self.minhashes)
        minhash &= ~run
        fp[run] = _spread(fp[run], doc[run], at[run])
        extent[run] |= _RUN_SHARED
        fp[minhash] = mix(key[minhash])
        extent[minhash] |= _MINHASH_SHARED
        return fp, extent


def run_key(fp: np.ndarray, cls: np.ndarray, extent: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(fp * _BASE + mix(cls + extent.astype(np.uint64)))


def _runs(source: DataFrame, span: int, gram: int, frequent) -> DataFrame:
    """``fp, cls, extent, doc, at`` of the runs of windows, placed by the broadcast ``frequent``."""
    block = BLOCK

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for rows, fp, cls, at, lo, n, total, left, right in window_runs(texts, span, gram, block):
                doc, extent = ids[rows], (lo << 16) | n
                fp, extent = frequent.value.placed(fp, cls, extent, doc, at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fp.view(np.int64)), pa.array(cls.view(np.int64)), pa.array(extent), pa.array(doc), pa.array((at << _MANY) | total), pa.array(left.view(np.int64)), pa.array(right.view(np.int64))],
                    names=["fp", "cls", "extent", "doc", "at", "left", "right"],
                )

    return source.mapInArrow(runs, "fp bigint, cls bigint, extent bigint, doc bigint, at bigint, left bigint, right bigint")


def _sample(source: DataFrame) -> DataFrame:
    return source.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLED)) == 0)


def _most(groups: DataFrame, *keys: str) -> DataFrame:
    """The largest groups of the sample that stand in two texts."""
    two = (F.col("lo.doc") < F.col("hi.doc")) & (F.col("n") >= FREQUENT)
    return groups.where(two).orderBy(F.desc("n"), *keys).limit(KEPT_GROUPS)


def shared_spans(docs: DataFrame, span: int = 300, gram: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc, start, end)``: windows and runs of windows of a document, each of ``span`` characters
    or more, that stand verbatim in another document; they may overlap."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text")).where(F.length("text") >= span).where("doc is not null")
    ends = lambda *c: (F.min(F.struct("doc", *c)).alias("lo"), F.max(F.struct("doc", *c)).alias("hi"))
    none = spark.sparkContext.broadcast(Frequent([], []))
    groups = persisted(_runs(_sample(source), span, gram, none).groupBy("fp", "cls", "extent").agg(*ends("at", "left", "right"), F.count("*").alias("n")), "samplegroups")
    shared = _most(groups, "fp", "cls", "extent").select("fp", "cls", "extent", "lo", "hi").collect()
    minhashes = groups.groupBy("fp").agg(F.min(F.struct("lo.doc")).alias("lo"), F.max(F.struct("hi.doc")).alias("hi"), F.sum("n").alias("n"))
    minhashes = sorted({r[0] for r in shared} | {r[0] for r in _most(minhashes, "fp").select("fp").collect()})
    column = lambda i: np.array([r[i] for r in shared], np.int64)
    runs = run_key(column(0).view(np.uint64), column(1).view(np.uint64), column(2)).view(np.int64).tolist()
    frequent = spark.sparkContext.broadcast(Frequent(runs, minhashes))
    # of a run that is known to be shared, two texts of the sample are compared with the edges
    sides = [(x["doc"], x["at"] >> _MANY, x["at"] & _COUNT, PARTNER, r["extent"], x["left"], x["right"]) for r in shared for x in (r["lo"], r["hi"])]
    found = _classified(_runs(source, span, gram, frequent))
    found = persisted(found.unionByName(spark.createDataFrame(sides, _FOUND)), "runs")
    # the windows of a run that hold the text before the MinHash, and those that hold the text behind it
    one = F.col("extent").bitwiseAND(0xFFFF)
    before = F.greatest(F.lit(0), F.least(one, F.shiftright("extent", 16).bitwiseAND(0xFFFF) - ((span - gram) // 2 - 1)))
    again = F.col("n") > one  # a run that repeats itself is taken whole on both sides
    side = lambda h, at, n: F.struct(F.col(h).alias("h"), at.alias("at"), n.cast("bigint").alias("n"))
    left = side("left", F.col("at"), F.when(again, F.when(before > 0, F.col("n")).otherwise(0)).otherwise(before))
    right = side("right", F.when(again, F.col("at")).otherwise(F.col("at") + before), F.when(again, F.when(before < one, F.col("n")).otherwise(0)).otherwise(F.col("n") - before))
    halves = found.where(F.col("kind") != WHOLE).select("doc", F.inline(F.array(left, right))).where("n > 0")
    halves = halves.select("h", "doc", F.shiftleft("at", _MANY).bitwiseOR(F.col("n")).alias("at"))
    edges = _in_two(halves).groupBy("doc").agg(F.collect_set(F.struct("at", "n")).alias("edges"))

    def windows_of(known):
        def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for doc, text, own in zip(*(b.column(i).to_pylist() for i in range(3))):
                    at = np.unique(np.concatenate([np.arange(e["at"], e["at"] + e["n"]) for e in own]))
                    lo, hi = int(at[0]), int(at[-1]) + span
                    h = Rolling(codes_of(text[lo:hi])).of(at - lo, at - lo + span)
                    # equal windows one after the other are one row
                    one = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1) | (at[1:] % _COUNT == 0)]))
                    n = np.diff(np.append(one, len(at)))
                    h, at = h[one], at[one]
                    hot = _member(h, known.value)
                    place = (at << _MANY) | n | np.where(hot, _KNOWN_SHARED, 0)
                    h = np.where(hot, _spread(h, np.full(len(h), doc), at), h)
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(at), doc)), pa.array(place)], names=["h", "doc", "at"])

        return windows

    schema = "h bigint, doc bigint, at bigint"
    nothing = spark.sparkContext.broadcast(np.zeros(0, np.uint64))
    some = _sample(source).join(_sample(edges), "doc").select("doc", "text", "edges").mapInArrow(windows_of(nothing), schema)
    known = [r[0] for r in _most(some.groupBy("h").agg(*ends("at"), F.count("*").alias("n")), "h").select("h").collect()]
    known = spark.sparkContext.broadcast(np.sort(np.array(known, np.int64).view(np.uint64)))
    each = source.join(edges, "doc").select("doc", "text", "edges").mapInArrow(windows_of(known), schema)
    spans = lambda df: df.select("doc", F.col("at").alias("start"), (F.col("at") + F.col("n") - 1 + span).alias("end"))
    return spans(found.where(F.col("kind") == WHOLE)).unionByName(spans(_in_two(each)))


def shared_characters(docs: DataFrame, span: int = 300, gram: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, shared_chars)`` of the documents with at least one shared span: the number of
    character positions covered by spans of ``span`` characters that stand in another document.

    Defined results: null texts and texts under ``span`` characters share nothing; a document
    whose whole text stands in another is covered whole; repetition inside one document does not
    count, nor does a repeated row of the same id.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = None
        total = start = end = 0
        for b in batches:
            out: list[tuple[int, int]] = []
            d, s, e = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for x, y, z in zip(d.tolist(), s.tolist(), e.tolist()):
                if x != doc:
                    if doc is not None:
                        out.append((doc, total + end - start))
                    doc, total, start, end = x, 0, y, z
                elif y > end:
                    total, start, end = total + end - start, y, z
                elif z > end:
                    end = z
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=[id_col, "shared_chars"])
        if doc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([total + end - start], pa.int64())], names=[id_col, "shared_chars"])

    spans = shared_spans(docs, span, gram, id_col, text_col).select("doc", "start", "end")
    return spans.repartition("doc").sortWithinPartitions("doc", "start").mapInArrow(merge, f"`{id_col}` bigint, shared_chars bigint")
