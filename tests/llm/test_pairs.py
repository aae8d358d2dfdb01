import random
from collections import Counter
from itertools import combinations

from quillrock.llm import pairs as P
from quillrock.llm.pairs import PairTable, message_baskets


def brute(baskets, least, lift):
    baskets = [set(x for x in b if x is not None) for b in baskets if b]
    baskets = [b for b in baskets if b]
    n, one, two = len(baskets), Counter(i for b in baskets for i in b), Counter(p for b in baskets for p in combinations(sorted(b), 2))
    return {(a, b, c, one[a], one[b], n) for (a, b), c in two.items() if c >= least and c * n >= lift * one[a] * one[b]}


def frame(spark, baskets, sign=1):
    return spark.createDataFrame([(b, sign, "clash") for b in baskets], "items array<string>, sign int, n string")


def keyed(spark, rows):
    """Rows of key, version, items."""
    return spark.createDataFrame([(k, (v, 0), items) for k, v, items in rows], "basket string, version struct<x:bigint,y:bigint>, items array<string>")


def got(table, lift):
    return set(map(tuple, table.scores(lift).collect()))


def test_signed_deltas(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    r = random.Random(5)
    items = [f"i{k:02}" for k in range(30)]
    baskets = [r.sample(items, r.choice([1, 2, 3, 5, 11])) for _ in range(150)] + [["i00", "i01", "i00", None]] * 40 + [[], None, [None]]
    for least, lift in ((2, 0.5), (4, 1.5)):
        whole = PairTable(spark, least)
        whole.apply(frame(spark, baskets))
        assert got(whole, lift) == brute(baskets, least, lift)
    step = PairTable(spark, 2)
    wrong = [["i00", "i29"]] * 7
    step.apply(frame(spark, baskets[:90] + wrong))
    assert got(step, 0.5) == brute(baskets[:90] + wrong, 2, 0.5)
    step.apply(frame(spark, baskets[90:]))
    step.apply(frame(spark, wrong, -1))
    assert got(step, 0.5) == brute(baskets, 2, 0.5)


def test_changed_baskets_move_only_their_pairs(spark):
    r = random.Random(6)
    items = [f"i{k:02}" for k in range(24)]
    rows = [(f"k{k}", 1, r.sample(items, 3)) for k in range(80)]
    t = PairTable(spark, 1)
    t.upsert(keyed(spark, rows[:50]))
    t.upsert(keyed(spark, rows[50:] + rows[40:60]))  # part of it comes again
    now = {k: i for k, _, i in rows}
    assert got(t, 0.1) == brute(now.values(), 1, 0.1)
    # one basket grows, a stale version of another comes late, a third loses all its items
    t.upsert(keyed(spark, [("k1", 2, ["x", "y", *now["k1"]]), ("k2", 0, ["x", "z"]), ("k3", 5, None), (None, 9, ["x", "y"])]))
    moved = {tuple(p) for p in t.rescore().collect()}
    now |= {"k1": ["x", "y", *now["k1"]], "k3": []}
    assert got(t, 0.1) == brute(now.values(), 1, 0.1)
    touched = {"x", "y", *rows[3][2]}
    assert ("x", "y") in moved and all(touched & set(p) for p in moved - set(combinations(sorted(now["k1"]), 2)))
    # nothing comes, nothing is computed
    t.upsert(keyed(spark, rows[:20]))
    assert t.rescore().count() == 0 and got(t, 0.1) == brute(now.values(), 1, 0.1)


def test_batches_of_deliveries_equal_one(spark, sf):
    m = spark.read.parquet(f"{sf}/messages.parquet")
    one, three = PairTable(spark, 2), PairTable(spark, 2)
    one.upsert(message_baskets(m))
    for k in range(3):
        three.upsert(message_baskets(m.where(f"batch_id % 3 = {k}")))
    assert got(one, 1.0) == got(three, 1.0) != set()


def test_empty(spark):
    c = PairTable(spark, 1)
    assert c.scores(1.0).count() == 0
    c.apply(frame(spark, []))
    assert c.scores(1.0).count() == 0


def test_a_hot_item(spark, monkeypatch):
    monkeypatch.setattr(P, "HOT_ITEMS", 5)
    baskets = [["hot", f"i{k % 20}"] for k in range(100)] + [[f"i{k % 7}", f"i{k % 5}"] for k in range(30)]
    t = PairTable(spark, 1)
    t.apply(frame(spark, baskets))
    assert got(t, 0.0) == brute(baskets, 1, 0.0)
