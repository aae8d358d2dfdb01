import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillrock.llm import leakage as L


def test_index_against_scanning():
    r = np.random.default_rng(2)
    for n, symbols, depth in ((1, 2, 1), (50, 3, 4), (400, 5, 10), (300, 2, 7), (900, 9, 2)):
        seq = r.integers(0, symbols, n) if n != 900 else np.tile(r.integers(1, symbols, 90), 10)
        seq[-1] = 0
        ends = np.flatnonzero(seq == 0)
        full = lambda i: [*seq[i : ends[np.searchsorted(ends, i)]].tolist(), 0, int(i)]
        key = lambda i: [(x, 0) for x in full(i)[:-2]] + [(0, int(ends[np.searchsorted(ends, i)]))]
        assert L.suffix_order(seq).tolist() == sorted(range(n), key=key)
        index = L.FMIndex.of(seq, symbols)
        phrases = r.integers(1, symbols, (60, depth)) if symbols > 1 else np.ones((1, depth), int)
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi):
            want = [i for i in range(n - depth + 1) if (seq[i : i + depth] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_an_index_serves_other_items_later(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "c d e f")], "doc_id bigint, text string")
    index = L.index_shards(docs)
    one = spark.createDataFrame([(7, "x c d e y")], "item_id bigint, passage string")
    assert sorted(tuple(x) for x in L.search_shards(index, one, 3).collect()) == [(1, 7, 2, 5), (2, 7, 0, 3)]
    assert L.search_shards(index, one.withColumn("passage", F.lit("d e f")), 2).count() == 2


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


@pytest.mark.parametrize("shard", [40, 2_000_000])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(L, "SHARD_WORDS", shard)
    monkeypatch.setattr(L, "ITEMS_PER_BLOCK", 3)
    r = random.Random(4)
    vocabulary = [f"v{k}" for k in range(12)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.choice([2, 5, 9]))), "c") for i in range(8)] + [(90, None, "c"), (91, "", "c"), (0, "zz zz", "c")]
    docs = []
    for d in range(60):
        w = r.choices(vocabulary + ["other"], k=r.randint(0, 60))
        if r.random() < 0.5:
            t = items[r.randrange(8)][1].split()
            w[5:5] = t[: r.randint(1, len(t))]
        docs.append((d, ", ".join(w).upper(), 1))
    docs += [(70, None, 1), (71, "", 1), (5, docs[5][1], 1)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, word_start int")
    it = spark.createDataFrame(items, "item_id bigint, passage string, text string")
    want = set()
    for i, p, _ in items:
        g = words(p)
        grams = {tuple(g[k : k + 4]) for k in range(len(g) - 3)}
        want |= {(d, i) for d, t, _ in docs if grams & {tuple(words(t)[k : k + 4]) for k in range(len(words(t)) - 3)}}
    assert {tuple(x) for x in L.leaked_items(df, it, 4).collect()} == want
    for x in L.leaked_spans(df, it, 4).collect():
        assert x.word_end - x.word_start >= 4
    assert L.leaked_items(df, it.limit(0), 4).count() == 0 and L.leaked_items(df.limit(0), it, 4).count() == 0
