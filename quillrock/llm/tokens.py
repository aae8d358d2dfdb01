"""Encoding of a corpus with a public byte-level BPE tokenizer.

Forced-boundary splitting: a pair of adjacent bytes that stands inside no token of the
vocabulary can never be merged across, so a text may be cut there, its fragments encoded
independently and the ids concatenated. A cut must not change how the tokenizer's pattern
splits either; that is certain between a printable ASCII character and a blank or line feed
(the pattern takes blanks only in front of a run or alone, and looks ahead only after blanks),
and between two letters of one run, where both sides are runs of letters still; of these the
Chinese characters of ``LETTERS`` are used. Which pairs are forced is read from the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: The pre-splitting pattern that belongs to the byte-level vocabularies.
BYTE_BPE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Least bytes of a fragment: short ones cost a call each, long ones memory.
FRAGMENT = 512
#: First bytes of the letters U+5000 to U+8FFF, three bytes each, between which a run may be cut.
LETTERS = (0xE5, 0xE8)


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=4)
def _encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=4)
def _forced(path: str) -> np.ndarray:
    """256 x 256: the pairs of bytes that stand inside no token."""
    forced = np.ones((256, 256), bool)
    for token in _ranks(path):
        b = np.frombuffer(token, np.uint8)
        forced[b[:-1], b[1:]] = False
    return forced


def cuts(data: bytes, forced: np.ndarray) -> np.ndarray:
    """The certain cuts of a text: offsets of the byte behind each."""
    b = np.frombuffer(data, np.uint8)
    if len(b) < 2:
        return np.zeros(0, np.int64)
    x, y = b[:-1], b[1:]
    blank = (x > 0x20) & (x < 0x7F) & ((y == 0x20) | (y == 0x0A))
    letter = np.zeros(len(x), bool)
    letter[2:] = (b[:-3] >= LETTERS[0]) & (b[:-3] <= LETTERS[1]) & (y[2:] >= LETTERS[0]) & (y[2:] <= LETTERS[1])
    return np.flatnonzero((blank | letter) & forced[x, y]) + 1


def fragments(text: str, path: str, least: int = FRAGMENT) -> list[str]:
    """The text cut at certain cuts, so that every fragment but the last has ``least`` bytes or more."""
    data = text.encode()
    at = cuts(data, _forced(path))
    out, start = [], 0
    while (k := int(np.searchsorted(at, start + least))) < len(at):
        out.append(data[start : at[k]].decode())
        start = int(at[k])
    return [*out, data[start:].decode()]


def encode_text(text: str, path: str, pattern: str, least: int = FRAGMENT) -> list[int]:
    """The ids of one text by fragments; equal to encoding the whole text."""
    return list(chain.from_iterable(map(_encoder(path, pattern).encode_ordinary, fragments(text, path, least))))


def encode_corpus(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)`` of every row, without special tokens.

    Strings that look like special tokens are ordinary text. Defined results: a null and an
    empty text both have the empty list; a repeated row comes out as often as it stands; other
    columns are not read. ``path`` is the vocabulary file (ranks), present on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode_text(t, path, pattern) if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
