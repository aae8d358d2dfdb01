import random

from quillrock.operators.deliveries import DeliveryStore, current_messages, keyed_deliveries, superseded_deliveries

SCHEMA = "row_id bigint, batch_id int, message_id string, `to` array<string>, cc array<string>, cid string, n_addr string"


def rows(spark, data):
    return spark.createDataFrame([(i, i % 3, m, t, c, "clash", "clash") for i, m, t, c in data], SCHEMA)


DATA = [
    (1, "<A@x>", ["a@x", "A@X "], None),
    (2, " a@X", ["a@x", "b..c@x"], []),
    (3, "A@x", ["'b.c@x'", '"L, F" <a@x>'], ["no address"]),
    (4, None, ["a@x"], None),
    (5, "", None, None),
    (6, "< >", [None], None),
    (7, "z@y", None, None),
    (8, "z@y", None, ["q@y"]),
]


def test_kept_and_superseded(spark):
    m = rows(spark, DATA)
    for batches in (1, 3):
        assert {r.row_id for r in superseded_deliveries(m, batches).collect()} == {1, 3, 7}
    assert {r.row_id for r in current_messages(m).collect()} == {2, 4, 5, 6, 8}


def test_upsert_is_idempotent_and_without_order(spark):
    k = keyed_deliveries(rows(spark, DATA))
    a, b = DeliveryStore(spark, 3), DeliveryStore(spark, 3)
    a.upsert(k)
    for part in (k.where("neg_id < -3"), k, k.where("neg_id >= -3"), k):
        b.upsert(part)
    assert sorted(a.compacted().collect()) == sorted(b.compacted().collect())
    assert "Exchange" not in b.compacted()._jdf.queryExecution().executedPlan().toString()


def test_one_identifier_for_all_and_empty(spark):
    m = rows(spark, [(i, "same", [f"{random.Random(i).randint(0, 3)}@x"], None) for i in range(1, 400)])
    assert superseded_deliveries(m).count() == 398
    assert superseded_deliveries(rows(spark, [])).count() == 0
    assert DeliveryStore(spark).compacted().count() == 0


def test_runs_are_merged_bucket_by_bucket(spark):
    k = keyed_deliveries(rows(spark, [(i, f"m{i % 23}", ["a@x"] * (i % 2), None) for i in range(1, 90)]))
    s = DeliveryStore(spark, 3, fan_in=3)
    s.upsert(k.where("neg_id % 2 = 0"))
    s.upsert(k.where("neg_id % 2 <> 0"))
    assert len(s.runs) == 2
    plan = s.merged(*[spark.table(r) for r in s.runs])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    s.upsert(k.where("neg_id > -5"))
    assert len(s.runs) == 1
    whole = DeliveryStore(spark, 3)
    whole.upsert(k)
    assert sorted(s.compacted().collect()) == sorted(whole.compacted().collect())


def test_release_removes_what_was_written(spark):
    import os

    from quillrock.session import _application_root, persisted, release

    persisted(spark.range(3).toDF("x"), "some").count()
    root = _application_root(spark).removeprefix("file://")
    assert os.listdir(root)
    release(spark)
    assert not os.path.exists(root)
    assert persisted(spark.range(3).toDF("x"), "some").count() == 3
