"""Graph walks against a recursive search in Python, on random policies; fixed worlds and traps."""

import random

import pytest
from pyspark.sql import functions as F

from quillrock.model import TUPLES, parse_tuples, tuple_text
from quillrock.operators import graph
from quillrock.operators.policystore import PolicyStore
from quillrock.plans import compiler
from quillrock.session import persisted
from quillrock.plans.rewrite import COMPUTED, CONTAINED, DIRECT, Namespace, default_namespaces, implies_rows, rule, rules_of_json, ttu_rows

WORLD = """group:legal#member@user:alice
group:legal-interns#member@user:mallory
group:hr#member@user:carol
group:partners#member@group:legal#member
group:everyone#member@group:partners#member
folder:hr#viewer@group:hr#member
doc:merger#viewer@group:legal#member
doc:handbook#viewer@group:everyone#member
doc:bob-notes#viewer@user:bob
doc:draft#owner@user:alice
doc:payroll#parent@folder:hr""".split("\n")
VERDICTS = {("alice", "merger"), ("alice", "handbook"), ("alice", "draft"), ("bob", "bob-notes"), ("carol", "payroll")}


def tuples(spark, texts):
    return parse_tuples(spark.createDataFrame([(t,) for t in texts], "text string")).where("valid").drop("text", "valid")


def split(t):
    left, who = t.split("@", 1)
    obj, rel = left.split("#", 1)
    ns, id_ = obj.split(":", 1)
    return ns, id_, rel, who


def allowed(texts, obj, user, most=16, both=True):
    """Cheapest hops by a search over states, written from the rules alone."""
    ts = [split(t) for t in texts]
    implies = {"viewer": {"viewer", "editor", "owner"}, "editor": {"editor", "owner"}}
    frontier, seen, cost = {(*obj.split(":", 1), "viewer")}, set(), 0
    while frontier and cost <= most:
        seen |= frontier
        new = set()
        for ns, id_, rel in frontier:
            node = ns in ("doc", "folder")
            rels = implies.get(rel, {rel}) if node else {rel}
            for tns, tid, trel, who in ts:
                if (tns, tid) == (ns, id_) and trel in rels:
                    if who == user:
                        return True
                    if "#" in who:
                        o, r = who.split("#")
                        new.add((*o.split(":", 1), r))
                if node and rel == "viewer" and trel == "parent":
                    if (tns, tid) == (ns, id_):
                        new.add((*who.split("#")[0].split(":", 1), "viewer"))
                    if both and who == f"{ns}:{id_}":
                        new.add((tns, tid, "viewer"))
        frontier, cost = new - seen, cost + 1
    return False


def checked(spark, texts, most=16, ns=None):
    t = persisted(tuples(spark, texts), "checked")
    return {(r.object, r.principal) for r in graph.check_pairs(graph.objects_of(t), t, ns, max_depth=most).collect()}


def test_world(spark):
    got = {(p.split(":")[1], o.split(":")[1]) for o, p in checked(spark, WORLD) if "#" not in p}
    assert got == VERDICTS


def policy(seed):
    """A random policy whose names are the seed's own, so that many lie in one table."""
    r = random.Random(seed)
    users, groups, docs, folders = ([f"{n}{k}-{seed}" for k in range(r.randint(*m))] for n, m in (("u", (1, 5)), ("g", (1, 5)), ("d", (1, 6)), ("f", (1, 3))))
    groups.append(f"g0-interns-{seed}")
    texts = set()
    for _ in range(r.randint(4, 24)):
        g, d = r.choice(groups), r.choice(docs)
        kind = r.random()
        if kind < 0.3:
            texts.add(f"group:{g}#member@user:{r.choice(users)}")
        elif kind < 0.5:
            texts.add(f"group:{g}#member@group:{r.choice(groups)}#member")
        elif kind < 0.7:
            texts.add(f"doc:{d}#{r.choice(['viewer', 'editor', 'owner'])}@group:{g}#member")
        elif kind < 0.8:
            texts.add(f"doc:{d}#{r.choice(['viewer', 'owner'])}@user:{r.choice(users)}")
        elif kind < 0.9:
            texts.add(f"folder:{r.choice(folders)}#viewer@group:{g}#member")
        else:
            f = r.choice(folders)
            texts.add(r.choice([f"doc:{d}#parent@folder:{f}", f"folder:{f}#parent@doc:{d}"]))
    return sorted(texts)


@pytest.mark.parametrize("both", [True, False])
def test_forty_random_policies(spark, both):
    """Check, plans, reach and tokens of forty policies against the search: no false allow, no false deny."""
    ns = default_namespaces(both)
    policies = [policy(seed) for seed in range(40)]
    t = persisted(tuples(spark, [x for p in policies for x in p]), "policies")
    objects = {r.object for r in graph.objects_of(t).collect()}
    want, people = set(), set()
    for texts in policies:
        own = {split(x)[3] for x in texts if "#" not in split(x)[3] and split(x)[3].startswith("user:")}
        people |= own
        want |= {(o, u) for o in {":".join(split(x)[:2]) for x in texts} & objects for u in own if allowed(texts, o, u, both=both)}
    assert len(want) > 50
    got = {(r.object, r.principal) for r in graph.check_pairs(graph.objects_of(t), t, ns).collect()}
    assert {(o, p) for o, p in got if p in people} == want
    asked = spark.createDataFrame([(o, u) for o in objects for u in people if o.split("-")[-1] == u.split("-")[-1]], "object string, principal string")
    assert {(r.object, r.principal) for r in graph.check_hits(asked, t, ns).collect()} == want
    assert {(r.object, r.principal) for r in graph.reachable_objects(t, ns).collect() if r.principal in people and r.object in objects} == want
    stamped = {r.object: set(r.grant_tokens) for r in compiler.stamp_tokens(graph.objects_of(t), t, ns).collect()}
    plans = [p for p in compiler.compile_plans(t, 10_000, namespaces=ns).collect() if p.principal in people]
    mine = [p for p in people][:7]
    few = compiler.compile_plans(t, 10_000, namespaces=ns, principals=spark.createDataFrame([(p,) for p in [*mine, "user:nobody"]], "principal string")).collect()
    assert {p.principal: sorted(p.explicit_ids) for p in few} == {p.principal: sorted(p.explicit_ids) for p in plans if p.principal in mine} | {"user:nobody": []}
    by_user = {u: {o for o, x in want if x == u} for u in people}
    by_token = {}
    for o, s in stamped.items():
        for x in s:
            by_token.setdefault(x, set()).add(o)
    for p in plans:
        assert set().union(*(by_token.get(x, set()) for x in p.grant_tokens)) == by_user[p.principal] == set(p.explicit_ids) & objects


def test_depth_limits_are_inclusive(spark):
    """Chains of 1, 2, 4, 8 and 16 hops, each at its exact depth and one below."""
    texts = []
    for n in (1, 2, 4, 8, 16):
        texts += [f"doc:deep{n}#viewer@group:c{n}g1#member", *[f"group:c{n}g{i}#member@group:c{n}g{i + 1}#member" for i in range(1, n)], f"group:c{n}g{n}#member@user:u{n}"]
    t = persisted(tuples(spark, texts), "chains")
    cost = {r.object: r.cost for r in graph.check_pairs(graph.objects_of(t), t).where("principal like 'user:%'").collect()}
    assert cost == {f"doc:deep{n}": n for n in (1, 2, 4, 8, 16)}
    asked = spark.createDataFrame([(f"doc:deep{n}", f"user:u{n}") for n in (1, 2, 4, 8, 16)], "object string, principal string")
    for limit in (4, 15):
        assert {r.object for r in graph.check_hits(asked, t, max_depth=limit).collect()} == {f"doc:deep{n}" for n in (1, 2, 4, 8, 16) if n <= limit}


def test_siblings_by_direction(spark):
    texts = ["doc:A#viewer@user:u", "doc:A#parent@folder:F", "doc:B#parent@folder:F"]
    assert ("doc:B", "user:u") in checked(spark, texts, ns=default_namespaces(True))
    assert ("doc:B", "user:u") not in checked(spark, texts)


def test_a_large_folder_has_no_pairs_of_siblings(spark):
    """100,000 documents of one folder, in both spellings: as many leaves as documents and grants."""
    n = 100_000
    d = spark.range(n).select(F.lit("doc").alias("object_ns"), F.concat(F.lit("d"), "id").alias("object_id"), F.lit("parent").alias("relation"), F.lit("folder").alias("principal_ns"), F.lit("f").alias("principal_id"), F.lit("").alias("principal_rel"))
    odd = F.substring("object_id", 2, 9).cast("int") % 2 == 1
    turned = d.where(odd).select(F.lit("folder").alias("object_ns"), F.lit("f").alias("object_id"), "relation", F.lit("doc").alias("principal_ns"), F.col("object_id").alias("principal_id"), "principal_rel")
    own = d.select("object_ns", "object_id", F.lit("viewer").alias("relation"), F.lit("user").alias("principal_ns"), F.concat(F.lit("u"), "object_id").alias("principal_id"), "principal_rel")
    t = graph.oriented(d.where(~odd).unionByName(turned).unionByName(own).unionByName(tuples(spark, ["folder:f#viewer@group:g#member", "group:g#member@user:a"])))
    assert graph.expand_leaves(graph.objects_of(t), t).count() == 2 * n
    reach = graph.Reach(t)
    assert reach.by_key.count() == n and {r.n for r in reach.counts().where("principal = 'user:a'").collect()} == {n}
    asked = spark.createDataFrame([("doc:d7", "user:a"), ("doc:d8", "user:ud8"), ("doc:d8", "user:ud7")], "object string, principal string")
    assert {tuple(r) for r in graph.check_hits(asked, t).collect()} == {("doc:d7", "user:a", 2), ("doc:d8", "user:ud8", 0)}


def test_parsing(spark):
    bad = ["", "a", "a:b", "a:b#c", "a:b#c@", "a:b#c@d", "a:b#c@d:", ":b#c@d:e", "a:#c@d:e", "a:b#@d:e", "a:b#c@d:e#", None]
    good = ["doc:x:y@z#viewer@user:a".replace("@z", ""), "doc:a#viewer@group:b#member", "doc:a#viewer@user:b@c"]
    rows = parse_tuples(spark.createDataFrame([(t,) for t in bad + good], "text string"))
    assert rows.where("not valid").count() == len(bad)
    back = rows.where("valid").select("text", tuple_text().alias("again")).collect()
    assert len(back) == 3 and all(r.text == r.again for r in back)


def test_store(spark):
    store = PolicyStore(spark)
    assert store.epoch == 0 and store.tuples().count() == 0
    t = tuples(spark, WORLD)
    assert store.apply(t) == (1, 11) and store.apply(t) == (2, 0)
    one = t.where("object_id = 'draft'")
    assert store.apply(deletes=one) == (3, 1) and store.delete(one) == 4
    assert store.apply(one, one) == (5, 1)  # deletes first, then writes
    assert store.read_by_principal("group", "legal", "member").count() == 2 and store.read("doc", "merger").count() == 1
    assert store.read_by_principal("user", "al").count() == 0
    assert PolicyStore(spark, store.path).epoch == 5 and store.define_namespace(Namespace("x")) == 6
    assert store.stats().first().tuples == 11


def test_two_writers_and_a_reader(spark, tmp_path):
    """Of two writers at one epoch the loser begins again; no state is lost, none is ever missing."""
    from concurrent.futures import ThreadPoolExecutor

    path = f"file://{tmp_path}/store"
    store = PolicyStore(spark, path)
    store.apply(tuples(spark, WORLD))

    def write(i):
        own = PolicyStore(spark, path)
        assert own.epoch >= 1
        return own.apply(tuples(spark, [f"doc:d{i}#viewer@user:u{i}"]))[0]

    with ThreadPoolExecutor(5) as pool:
        reads = pool.submit(lambda: [(e, t.count()) for e, t, _ in (PolicyStore(spark, path).state() for _ in range(6))])
        epochs = list(pool.map(write, range(4)))
        assert all(n == 10 + e for e, n in reads.result())
    assert sorted(epochs) == [2, 3, 4, 5] and store.epoch == 5 and store.tuples().count() == 15
    store.define_namespace(Namespace("x", (rule("r", COMPUTED, "q"),)))
    assert PolicyStore(spark, path).namespace("x").computed("r") == {"q"}


def test_rules():
    for ns in default_namespaces().values():
        assert Namespace.from_json(ns.to_json()) == ns
    nested = {"kind": "union", "children": [{"kind": "this"}, {"kind": "union", "children": [{"kind": "computed_userset", "relation": "a"}, {"kind": "tuple_to_userset", "tupleset": "p", "computed_relation": "v"}]}]}
    assert rules_of_json("r", nested) == [rule("r", DIRECT), rule("r", COMPUTED, "a"), rule("r", CONTAINED, "p", "v", True)]
    with pytest.raises(ValueError):
        rules_of_json("r", {"kind": "intersection"})
    assert ("doc", "owner", "viewer") in implies_rows(default_namespaces()) and ("group", "owner", "member") not in implies_rows(default_namespaces())
    assert ("doc", "viewer", "parent", "viewer", False) in ttu_rows(default_namespaces()) and len(ttu_rows(default_namespaces())) == 2
    loop = {"n": Namespace("n", (rule("a", COMPUTED, "b"), rule("b", COMPUTED, "a")))}
    assert len(implies_rows(loop)) == 4


def test_empty_binds_and_admits_nothing(spark):
    rows = [("grant_tokens", [], []), ("enumerate", [], []), ("exact_scan", [], []), ("unfiltered", [], []), ("grant_tokens", ["t"], []), ("enumerate", ["t"], ["doc:a"]), ("enumerate", [], ["a"])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, t array<string>, ids array<string>")
    c = compiler.admits(F.col("s"), F.col("t"), F.col("ids"), F.lit("doc:a"), F.lit("a"), F.array(F.lit("t")))
    none = compiler.admits(F.col("s"), F.col("t"), F.col("ids"), F.lit("doc:a"), F.lit("a"), F.lit(None).cast("array<string>"))
    got = {r.i: (r.a, r.b, r.n) for r in df.select("i", c.alias("a"), none.alias("b"), compiler.admits_nothing(F.col("s"), F.col("t"), F.col("ids")).alias("n")).collect()}
    assert [got[i][0] for i in range(7)] == [False, False, False, True, True, True, True]
    assert [got[i][1] for i in range(7)] == [False, False, False, True, False, False, True]
    assert [got[i][2] for i in range(7)] == [True, True, True, False, False, False, False]


def test_strategies(spark):
    df = spark.createDataFrame([(0, False, 9), (9, False, 9), (10, True, 9), (512, False, 10**6), (513, False, 10**6), (4096, False, 10**6), (4097, False, 10**6)], "n int, t boolean, c int")
    got = [r.s for r in df.select(compiler.choose_strategy(F.col("n"), F.col("t"), F.col("c")).alias("s")).collect()]
    assert got == ["enumerate", "unfiltered", "grant_tokens", "enumerate", "exact_scan", "exact_scan", "grant_tokens"]


def test_cache():
    cache = compiler.PlanCache(2)
    for e in range(3):
        cache.put(compiler.PlanKey("user:a", e), {"epoch": e})
    assert len(cache) == 2 and cache.get(compiler.PlanKey("user:a", 1), 2) is None and cache.get(compiler.PlanKey("user:a", 2), 2) == {"epoch": 2}


def test_malformed_and_empty(spark):
    none = spark.createDataFrame([], TUPLES)
    assert graph.principal_closure(none).count() == 0 and graph.reachable_objects(none).count() == 0
    hits = spark.createDataFrame([("user:a", "nonsense"), ("user:a", None)], "principal string, object_ref string")
    assert graph.recheck(hits, graph.check_pairs(graph.objects_of(none), none)).where("kept").count() == 0
