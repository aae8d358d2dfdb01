"""From documents to stamped, embedded chunks."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrock.operators.mail import QUOTE_MARKERS

# The tokens of the approximate tokenizer, and what ends a sentence.
TOKEN = re.compile(r"\w+(?:[.'’-]\w+)*|[^\w\s]", re.UNICODE)
SENTENCE_END = re.compile(r"[.!?…]['\"’”)\]]*$")
TOKENIZER = "approx-word-v1"


@dataclass(frozen=True, slots=True)
class Chunking:
    target: int = 256
    overlap: int = 48
    least: int = 16
    slack: int = 32

    def __post_init__(self):
        if not 0 <= self.overlap < self.target:
            raise ValueError("overlap must be at least 0 and less than target")

    @property
    def fingerprint(self) -> str:
        return f"{self.target}-{self.overlap}-{self.least}-{self.slack}"


def quote_boundaries(text: str) -> list[int]:
    """Offsets at which quoted mail begins, and the end of the header."""
    found = {m.start() for marker in QUOTE_MARKERS for m in re.finditer(re.escape(marker), text)}
    if (end := text.find("\n\n")) > 0:
        found.add(end + 2)
    return sorted(o for o in found if 0 < o < len(text))


def _windows(ends: np.ndarray, n: int, cfg: Chunking) -> list[tuple[int, int]]:
    """Token ranges over a segment of ``n`` tokens. ``ends[i]`` is the greatest number of tokens up to ``i``
    whose last one ends a sentence (0: none)."""
    ranges = [(0, n)] if n <= cfg.target else []
    first = 0
    while not ranges or ranges[-1][1] < n:
        stop = min(n, first + cfg.target)
        sentence = int(ends[stop])
        if stop < n and sentence > max(first, stop - cfg.slack):
            stop = sentence
        ranges.append((first, stop))
        first = max(stop - cfg.overlap, first + 1)
    return ranges


def split_text(text: str, cfg: Chunking = Chunking(), boundaries: list[int] | None = None) -> list[tuple[int, int, int]]:
    """``(char_start, char_end, n_tokens)`` of each chunk.

    The tokens are first cut into segments at the boundaries. Windows of up to ``target`` tokens
    run over each segment, cut back by up to ``slack`` tokens to the end of a sentence, each
    overlapping the one before. A piece that lies in the one before, or has fewer than ``least``
    tokens, is left out; the first piece of a text stays however short it is.
    """
    tokens = [(m.start(), m.end(), bool(SENTENCE_END.search(m[0]))) for m in TOKEN.finditer(text)]
    if not tokens:
        return []
    start, stop, final = (np.array(c) for c in zip(*tokens))
    cuts = np.unique(np.concatenate([[0], np.searchsorted(start, boundaries or []), [len(tokens)]]))
    chunks: list[tuple[int, int, int]] = []
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        place = np.arange(1, high - low + 1)
        ends = np.concatenate([[0], np.maximum.accumulate(np.where(final[low:high], place, 0))])
        chunks += [(int(start[low + i]), int(stop[low + j - 1]), j - i) for i, j in _windows(ends, high - low, cfg)]
    kept = chunks[:1]
    for c in chunks[1:]:
        if c[1] > kept[-1][1] and c[2] >= cfg.least:
            kept.append(c)
    return kept


def chunk_id(object_ref: str, ordinal: int, text: str) -> str:
    return "ch_" + hashlib.blake2b(f"{object_ref}\0{ordinal}\0{TOKENIZER}\0{text}".encode(), digest_size=16).hexdigest()


def chunked(docs: DataFrame, cfg: Chunking = Chunking(), quoted: bool = True) -> DataFrame:
    """``chunk_id, object_ref, ordinal, text, char_start, char_end, n_tokens`` of ``object_ref, text``.

    Null and blank texts have no chunk. Extra columns are not read.
    """
    names = ["chunk_id", "object_ref", "ordinal", "text", "char_start", "char_end", "n_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for ref, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text and text.strip():
                    for i, (s, e, n) in enumerate(split_text(text, cfg, quote_boundaries(text) if quoted else None)):
                        rows.append((chunk_id(ref or "", i, text[s:e]), ref, i, text[s:e], s, e, n))
            kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

    return docs.select("object_ref", "text").mapInArrow(run, "chunk_id string, object_ref string, ordinal int, text string, char_start int, char_end int, n_tokens int")


def units(text: Column) -> Column:
    """Words of ``[a-z0-9]`` and their bigrams ``a_b``."""
    w = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    pairs = F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.concat(w, pairs)


def hashed_features(docs: DataFrame, id_col: str, dim: int = 64) -> DataFrame:
    """``id, idx, value``: the signed hashing trick over units, by md5 (which SQL can compute): index from
    the first eight hex digits, sign from the ninth; not yet of unit length."""
    h = F.md5("unit")
    idx = (F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") % dim).cast("int")
    sign = F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    each = docs.select(id_col, F.explode(units(F.col("text"))).alias("unit"))
    return each.select(id_col, idx.alias("idx"), sign.alias("s")).groupBy(id_col, "idx").agg(F.sum("s").alias("value")).where("value <> 0")


def hash_embedding(texts: list[str | None], dim: int = 384, seed: int = 0) -> np.ndarray:
    """Unit-length vectors by keyed positions of BLAKE2b: index from four bytes, sign from the fifth."""
    out = np.zeros((len(texts), dim), np.float32)
    known: dict[str, tuple[int, int]] = {}
    prefix = seed.to_bytes(4, "little")
    for i, t in enumerate(texts):
        w = re.findall("[a-z0-9]+", (t or "").lower())
        for u in (*w, *(f"{a}_{b}" for a, b in zip(w, w[1:]))):
            at = known.get(u)
            if at is None:
                d = hashlib.blake2b(prefix + u.encode(), digest_size=8).digest()
                at = known[u] = (int.from_bytes(d[:4], "little") % dim, 1 if d[4] & 1 else -1)
            out[i, at[0]] += at[1]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def text_key(text: Column, dim: int = 384, seed: int = 0) -> Column:
    """Under which the vector of a text is cached: equal for equal texts of one embedder."""
    return F.sha2(F.concat(F.lit(f"hash-{seed}\0{dim}\0"), text), 256)


def embedded(chunks: DataFrame, cache: DataFrame | None = None, dim: int = 384, seed: int = 0) -> DataFrame:
    """``key, embedding`` of each distinct text not in ``cache`` (``key``), ready to be joined or appended."""
    key = text_key(F.col("text"), dim, seed)
    distinct = chunks.where("text is not null").select(key.alias("key"), "text").dropDuplicates(["key"])
    if cache is not None:
        distinct = distinct.join(cache.select("key"), "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = hash_embedding(b.column(1).to_pylist(), dim, seed)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float32()))], names=["key", "embedding"])

    return distinct.mapInArrow(run, "key string, embedding array<float>")


def embedding_counters(chunks: DataFrame) -> DataFrame:
    """One row: texts, distinct ones that must be computed, and those saved by being equal."""
    return chunks.where("text is not null").agg(F.count("*").alias("texts"), F.count_distinct(F.sha2("text", 256)).alias("computed")).withColumn("deduplicated", F.col("texts") - F.col("computed"))


def ingest_report(docs: DataFrame, stamped: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """One row of counters over ``object_ref, text``: seen, skipped (done before), empty, rejected (nobody may
    see it), indexed. A document counts under the first that applies."""
    d = docs.select("object_ref", F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")) != "", F.lit(False)).alias("some"))
    d = d.join(stamped.select(F.col("object").alias("object_ref"), (F.size("grant_tokens") > 0).alias("granted")), "object_ref", "left")
    if done is None:
        d = d.withColumn("done", F.lit(False))
    else:
        d = d.join(done.select("object_ref").distinct().withColumn("done", F.lit(True)), "object_ref", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    ok = F.coalesce("granted", F.lit(False))
    return d.agg(
        F.count("*").alias("seen"), F.count_if("done").alias("skipped"), F.count_if(~F.col("done") & ~F.col("some")).alias("empty"),
        F.count_if(~F.col("done") & F.col("some") & ~ok).alias("rejected"), F.count_if(~F.col("done") & F.col("some") & ok).alias("indexed"),
    )
