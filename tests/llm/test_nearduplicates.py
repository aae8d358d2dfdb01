import random
import re

import pytest

from quillrock.llm import nearduplicates as N
from quillrock.llm.nearduplicates import level_plan, most_differing, similar_messages, similar_pairs, word_key
from pyspark.sql import functions as F


def shingles(t, w=3):
    x = re.findall(r"[^\W_]+", t.lower())
    return {tuple(x[i : i + w]) for i in range(len(x) - w + 1)}


def brute(texts, threshold):
    s = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(i for i in s if s[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Été", "straße", "中文"]
    texts = []
    for _ in range(n):
        base = r.choices(vocabulary, k=r.choice([4, 9, 20, 60, 150, 300]))
        texts.append(base)
        for _ in range(r.randint(0, 3)):
            v = base[:]
            for _ in range(r.randint(0, max(1, len(v) // 12))):
                at = r.randrange(len(v))
                v[at : at + r.randint(0, 2)] = r.choices(vocabulary, k=r.randint(0, 2))
            texts.append(v)
    return {i: " ".join(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("seed, cap", [(1, 64), (2, 8)])
def test_against_brute_force(spark, seed, cap):
    texts = corpus(seed)
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    pairs, classes = similar_pairs(word_key(df, F.col("text")).drop("text"), df, 0.6, 3, cap=cap)
    members = {}
    for r in classes.collect():
        members.setdefault(r["class"], []).append(r.id)
    got = {tuple(sorted((x, y))) for r in pairs.collect() for x in members[r.a] for y in members[r.b]}
    got |= {(x, y) for m in members.values() for x in m for y in m if x < y and shingles(texts[x])}
    assert got == brute(texts, 0.6)


def test_family_of_more_than_the_cap(spark):
    r = random.Random(7)
    base = [f"w{k}" for k in range(200)]
    texts = {}
    for i in range(30):
        v = base[:]
        for _ in range(4):
            v[r.randrange(200)] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(v)
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    pairs, _ = similar_pairs(word_key(df, F.col("text")).drop("text"), df, 0.6, 3, cap=4)
    assert {(r.a, r.b) for r in pairs.collect()} == brute(texts, 0.6)


def found(spark, texts, cap):
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    pairs, _ = similar_pairs(word_key(df, F.col("text")).drop("text"), df, 0.6, 3, cap=cap)
    return [(r.a, r.b) for r in pairs.collect()]


@pytest.mark.parametrize("block", [4096, 16])
def test_family_over_the_cap_across_a_size_band(spark, monkeypatch, block):
    """Sizes on both sides of the band edge at 165 shingles, similarities around 0.6 to 0.7."""
    monkeypatch.setattr(N, "HOT_BLOCK", block)
    r = random.Random(11)
    base = [f"w{k}" for k in range(130)]
    texts = {i: " ".join(base + [f"x{i}y{k}" for k in range(r.randint(22, 50))]) for i in range(100)}
    got = found(spark, texts, 64)
    assert set(got) == brute(texts, 0.6) and len(got) == len(set(got))


def test_smallest_cap(spark):
    texts = {i: t for i, t in enumerate(dict.fromkeys(corpus(2).values()))}
    assert set(found(spark, texts, 2)) == brute(texts, 0.6)


@pytest.mark.parametrize("cap", [10**9, 64])
def test_small_sets_are_exact(spark, cap):
    """Two shingles inside three: of such pairs the sketches drop more than ``miss``."""
    r = random.Random(3)
    texts = {}
    for k in range(6000):
        x = [f"a{r.randrange(10**9)}" for _ in range(5)]
        texts[2 * k], texts[2 * k + 1] = " ".join(x[:4]), " ".join(x)
    if cap == 64:  # one shingle that all have: the first three words
        texts = {i: "one and same " + t for i, t in list(texts.items())[:400]}
    assert set(found(spark, texts, cap)) == brute_sparse(texts, 0.6)


def brute_sparse(texts, threshold):
    """As ``brute``, but only among texts that share a shingle."""
    s = {i: shingles(t) for i, t in texts.items()}
    by = {}
    for i, x in s.items():
        for y in x:
            by.setdefault(y, []).append(i)
    pairs = {(a, b) for ids in by.values() for k, a in enumerate(sorted(ids)) for b in sorted(ids)[k + 1 :]}
    return {(a, b) for a, b in pairs if len(s[a] & s[b]) >= threshold * len(s[a] | s[b])}


def test_messages(spark):
    long = " ".join(f"word{k}" for k in range(80))
    rows = [
        (1, "<A@x>", "s", long, "clash"), (2, "a@x", None, long, "clash"), (3, "b@x", "s", long + " more", None), (4, "c@x", None, None, None),
        (5, "d@x", "s", "", None), (6, None, "s", long, None), (7, "e@x", "S!", long.upper(), None), (8, "f@x", None, "hi", None), (9, "g@x", None, "hi", None),
    ]
    m = spark.createDataFrame(rows, "row_id bigint, message_id string, subject string, body string, id string")
    got = {tuple(r) for r in similar_messages(m).collect()}
    assert got == {("a@x", "b@x"), ("a@x", "e@x"), ("b@x", "e@x")}
    assert similar_messages(m.limit(0)).count() == 0


def test_plans():
    for level in range(0, 40):
        n1, g = level_plan(level, 0.6, 1e-4)
        assert (n1 == 0 and g == 0) or 0 < g <= n1
    assert 20 < most_differing(0.6, 1e-4) < 64


def test_boilerplate_family_of_ten_thousand(spark):
    """All share 60 words of boilerplate, of sizes over several bands; planted are edits of the rest that
    leave a similarity of 0.6 to 0.7. Recall is asked for as promised, and nothing else is found."""
    r = random.Random(13)
    stock = " ".join(f"s{k}" for k in range(60))
    texts, planted = {}, set()
    for i in range(0, 10_000, 2):
        own = [f"x{i}y{k}" for k in range(r.randint(60, 200))]
        texts[i] = stock + " " + " ".join(own)
        if i % 25 == 0:
            texts[i + 1] = stock + " " + " ".join(own[: -int(len(own) * 0.4)])
            planted.add((i, i + 1))
        else:
            texts[i + 1] = stock + " " + " ".join(f"z{i}y{k}" for k in range(r.randint(60, 200)))
    planted = {(a, b) for a, b in planted if len(shingles(texts[a]) & shingles(texts[b])) >= 0.6 * len(shingles(texts[a]) | shingles(texts[b]))}
    got = set(found(spark, texts, 64))
    assert len(planted) > 150 and got <= planted
    assert len(got) >= 0.99 * len(planted)


def test_a_class_of_more_members_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(N, "CLASS_BLOCK", 4)
    m = spark.createDataFrame([(i, f"m{i:02}@x", None, "one two three four" if i % 3 else f"w{i} b c d e") for i in range(30)], "row_id bigint, message_id string, subject string, body string")
    got = sorted(tuple(r) for r in similar_messages(m).collect())
    ids = [f"m{i:02}@x" for i in range(30) if i % 3]
    assert got == [(x, y) for x in ids for y in ids if x < y]
