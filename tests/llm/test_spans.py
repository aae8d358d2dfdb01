import random

import pytest

from quillrock.llm import spans as S


def brute(docs, span):
    docs = {i: t for i, t in docs if t and len(t) >= span}
    seen = {}
    for i, t in docs.items():
        for k in range(len(t) - span + 1):
            seen.setdefault(t[k : k + span], set()).add(i)
    out = {}
    for i, t in docs.items():
        cover = set()
        for k in range(len(t) - span + 1):
            if len(seen[t[k : k + span]]) > 1:
                cover.update(range(k, k + span))
        if cover:
            out[i] = len(cover)
    return out


@pytest.mark.parametrize("seed, block, sampled", [(1, 1 << 18, 64), (2, 64, 1), (3, 100, 2), (4, 1 << 18, 1), (5, 64, 3)])
def test_against_brute_force(spark, monkeypatch, seed, block, sampled):
    """Whatever is known beforehand of frequent groups, the result is that of brute force."""
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "SAMPLED", sampled)
    monkeypatch.setattr(S, "FREQUENT", 2)
    monkeypatch.setattr(S, "KEPT_GROUPS", 30)
    r = random.Random(seed)
    alphabet = "ab" if seed == 3 else "abcdefgh 中\U0001f600"
    pieces = ["".join(r.choices(alphabet, k=r.randint(10, 90))) for _ in range(8)]
    docs = []
    for d in range(50):
        t = "".join(r.choice(pieces)[r.randint(0, 8) :] if r.random() < 0.6 else "".join(r.choices(alphabet, k=r.randint(1, 40))) for _ in range(r.randint(0, 6)))
        docs.append((d, t))
    docs += [(60, "ab" * 150), (61, "ab" * 120), (62, "x" * 200), (63, docs[0][1]), (64, None), (65, "")]
    df = spark.createDataFrame([(*d, "c", "c") for d in docs], "doc_id bigint, text string, doc string, at string")
    got = dict(S.shared_characters(df, 30, 8).collect())
    assert got == brute(docs, 30)


def test_repeated_rows_and_empty(spark):
    t = "".join(random.Random(9).choices("abcdef", k=400))
    df = spark.createDataFrame([(1, t), (1, t), (2, "y" * 400)], "doc_id bigint, text string")
    assert S.shared_characters(df).count() == 0
    assert S.shared_characters(df.limit(0)).count() == 0
    df = spark.createDataFrame([(1, t), (2, t)], "doc_id bigint, text string")
    assert dict(S.shared_characters(df).collect()) == {1: 400, 2: 400}


def test_a_span_that_a_third_of_the_texts_share(spark, monkeypatch):
    """Its rows are known from the sample and spread; a few texts share other windows with it."""
    monkeypatch.setattr(S, "SAMPLED", 4)
    r = random.Random(11)
    stock = "".join(r.choices("abcdefgh ", k=120))
    own = lambda n: "".join(r.choices("abcdefgh ", k=n))
    docs = [(k, own(20 + k % 7) + stock + own(15)) for k in range(200)] + [(200 + k, own(60)) for k in range(380)]
    docs += [(600, own(9) + stock[7:50] + own(9)), (601, stock[60:95]), (602, stock[60:88])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert dict(S.shared_characters(df, 30, 8).collect()) == brute(docs, 30)


def test_a_text_that_repeats_itself_is_few_rows():
    import numpy as np

    for text in ("a" * 50_000, "ab" * 20_000):
        runs = [x for x in S.window_runs([text], 300, 50)]
        assert sum(len(x[0]) for x in runs) < 10
        assert sum(int(np.sum(x[6])) for x in runs) == len(text) - 299
