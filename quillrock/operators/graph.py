"""Bounded recursive queries over permission tuples.

Every walk is a frontier join: one round joins the newest nodes to the edges, keeps those
not seen before, and writes them, until nothing is new or the depth is reached. Rounds are
written to the shared folder, so a lost executor costs one round. Rewrite rules come as two
tables of a few rows (their size follows from the declared namespaces), which are broadcast.

Subject hops of all principals are found from the closure of the usersets alone: a principal
takes one hop to its direct usersets and then follows their closure, so memberships are
joined once, however many rounds the nesting takes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillrock.model import TUPLE_COLUMNS, object_ref, principal_ref
from quillrock.plans.rewrite import Namespace, default_namespaces, implies_table, ttu_table
from quillrock.session import persisted, side_by_side

MAX_DEPTH, OBJECT_DEPTH, SUBJECT_DEPTH = 16, 8, 8


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def subject_keys(tuples: DataFrame) -> DataFrame:
    """Distinct usersets on the principal side: ``node``."""
    return tuples.where("principal_rel <> ''").select(principal_ref().alias("node")).distinct()


def held_relations(tuples: DataFrame, namespaces: dict[str, Namespace]) -> DataFrame:
    """Each tuple once per relation that it grants (``target_rel``); an undeclared one grants itself."""
    implies = F.broadcast(implies_table(tuples.sparkSession, namespaces))
    j = tuples.join(implies, (tuples.object_ns == implies.ns) & (tuples.relation == implies.held_rel), "left")
    return j.select(*tuples.columns, F.coalesce("target_rel", "relation").alias("target_rel"))


def membership_edges(tuples: DataFrame, keys: DataFrame, namespaces: dict[str, Namespace]) -> DataFrame:
    """``src, dst``: the principal ``src`` holds the userset ``dst``, one of ``keys``."""
    held = held_relations(tuples, namespaces)
    edges = held.select(principal_ref().alias("src"), F.concat(object_ref(), F.lit("#"), F.col("target_rel")).alias("dst")).where("src <> dst").distinct()
    return edges.join(keys.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def walk(seeds: DataFrame, edges: DataFrame, depth: int, label: str) -> DataFrame:
    """``root, node, hop``: the fewest hops (up to ``depth``) from each seed ``root, node`` along ``src, dst``."""
    edges = persisted(edges, f"{label}-edges")
    rounds = [persisted(seeds.select("root", "node").distinct().withColumn("hop", F.lit(0)), label)]
    while len(rounds) <= depth:
        step = rounds[-1].join(edges, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        seen = _union(rounds).select("root", "node")
        new = persisted(step.join(seen, ["root", "node"], "left_anti").withColumn("hop", F.lit(len(rounds))), label)
        if new.isEmpty():
            break
        rounds.append(new)
    return _union(rounds)


def userset_closure(tuples: DataFrame, namespaces: dict[str, Namespace], depth: int) -> DataFrame:
    """``root, node, hop`` among the usersets of the principal side."""
    keys = subject_keys(tuples)
    edges = membership_edges(tuples.where("principal_rel <> ''"), keys, namespaces)
    return walk(keys.select(F.col("node").alias("root"), "node"), edges, depth, "usersets")


def principal_closure(tuples: DataFrame, namespaces: dict[str, Namespace] | None = None, depth: int = SUBJECT_DEPTH) -> DataFrame:
    """``principal, userset, hop, is_grantor`` of every principal of the tuples.

    The principal itself is at hop 0. All that is listed appears as a principal somewhere,
    so everything is a grantor; nodes at the last hop are, too.
    """
    ns = namespaces or default_namespaces()
    inner = persisted(userset_closure(tuples, ns, depth), "closure")
    direct = membership_edges(tuples.where("principal_rel = ''"), subject_keys(tuples), ns)
    reached = direct.join(inner, F.col("dst") == F.col("root")).select(F.col("src").alias("principal"), F.col("node").alias("userset"), (F.col("hop") + 1).alias("hop"))
    own = tuples.where("principal_rel = ''").select(principal_ref().alias("principal")).distinct()
    concrete = own.select("principal", F.col("principal").alias("userset"), F.lit(0).alias("hop")).unionByName(reached.where(F.col("hop") <= depth))
    return concrete.unionByName(inner.select(F.col("root").alias("principal"), F.col("node").alias("userset"), "hop")).groupBy("principal", "userset").agg(F.min("hop").alias("hop")).withColumn("is_grantor", F.lit(True))


def containment_edges(tuples: DataFrame, namespaces: dict[str, Namespace], relation: str = "viewer") -> DataFrame:
    """``src, dst``: what is granted on the container ``dst`` holds on the object ``src``.

    The child's namespace decides. Its own tupleset tuples name containers; where the rule reads
    both ways, so do tuples in which the child stands as the principal, usersets excluded.
    """
    ttu = F.broadcast(ttu_table(tuples.sparkSession, namespaces).where((F.col("rel") == relation) & (F.col("computed_rel") == relation)))
    forward = tuples.join(ttu, (F.col("object_ns") == F.col("ns")) & (F.col("relation") == F.col("tupleset")))
    forward = forward.select(object_ref().alias("src"), object_ref("principal_ns", "principal_id").alias("dst"))
    back = tuples.where("principal_rel = ''").join(ttu.where("both"), (F.col("principal_ns") == F.col("ns")) & (F.col("relation") == F.col("tupleset")))
    back = back.select(object_ref("principal_ns", "principal_id").alias("src"), object_ref().alias("dst"))
    return forward.unionByName(back).where("src <> dst").distinct()


def oriented(tuples: DataFrame, relation: str = "parent", outer: str = "folder", inner: str = "doc") -> DataFrame:
    """The tuples with containment in one spelling, ``inner#parent@outer``: those that name the inner
    object as the parent of the outer one are turned around. Other tuples stay as they are.

    Read one way, inheritance then goes from folders to what they hold. Read both ways it goes
    from any object of a folder to all others too, and one folder of N documents has N * N pairs.
    """
    turn = (F.col("relation") == relation) & (F.col("object_ns") == outer) & (F.col("principal_ns") == inner) & (F.col("principal_rel") == "")
    swap = {"object_ns": "principal_ns", "object_id": "principal_id", "principal_ns": "object_ns", "principal_id": "object_id"}
    return tuples.select(*[F.when(turn, F.col(swap[c])).otherwise(F.col(c)).alias(c) if c in swap else F.col(c) for c in tuples.columns]).dropDuplicates(TUPLE_COLUMNS)


def containers(objects: DataFrame, tuples: DataFrame, namespaces: dict[str, Namespace], depth: int = OBJECT_DEPTH) -> DataFrame:
    """``object, container, depth`` of the objects (``object``), themselves at depth 0."""
    w = walk(objects.select(F.col("object").alias("root"), F.col("object").alias("node")), containment_edges(tuples, namespaces), depth, "containers")
    return w.select(F.col("root").alias("object"), F.col("node").alias("container"), F.col("hop").alias("depth"))


def objects_of(tuples: DataFrame, ns: str = "doc") -> DataFrame:
    """Distinct objects of a namespace on the object side: ``object``."""
    return tuples.where(F.col("object_ns") == ns).select(object_ref().alias("object")).distinct()


def direct_grants(tuples: DataFrame, namespaces: dict[str, Namespace], relation: str = "viewer") -> DataFrame:
    """``object, subject`` of the tuples that grant ``relation`` on their own object."""
    return held_relations(tuples, namespaces).where(F.col("target_rel") == relation).select(object_ref().alias("object"), principal_ref().alias("subject")).distinct()


def expand_leaves(objects: DataFrame, tuples: DataFrame, namespaces: dict[str, Namespace] | None = None, relation: str = "viewer") -> DataFrame:
    """``object, subject, depth``: the subjects granted ``relation`` as written, over containment.

    It stops at the edge of groups: a userset stays a userset.
    """
    ns = namespaces or default_namespaces()
    up = persisted(containers(objects, tuples, ns), "up")
    grants = direct_grants(tuples, ns, relation).withColumnRenamed("object", "container")
    return up.join(grants, "container").groupBy("object", "subject").agg(F.min("depth").alias("depth"))


def expand_nodes(objects: DataFrame, tuples: DataFrame, namespaces: dict[str, Namespace] | None = None, relation: str = "viewer") -> DataFrame:
    """``object, node, depth, relation, subjects``: the expansion tree as rows, one per container
    and granting relation, with its subjects sorted."""
    ns = namespaces or default_namespaces()
    up = persisted(containers(objects, tuples, ns), "up")
    held = held_relations(tuples, ns).where(F.col("target_rel") == relation)
    held = held.select(object_ref().alias("node"), "relation", principal_ref().alias("subject")).distinct()
    rows = up.withColumnRenamed("container", "node").join(held, "node")
    return rows.groupBy("object", "node", "depth", "relation").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))


def check_pairs(
    objects: DataFrame, tuples: DataFrame, namespaces: dict[str, Namespace] | None = None, relation: str = "viewer", max_depth: int = MAX_DEPTH
) -> DataFrame:
    """``object, principal, cost`` of every allowed pair: the fewest userset and containment hops from the
    object to a tuple that names the principal, up to ``max_depth``; what is absent is denied.

    Relations of the same object cost nothing. A cycle changes nothing, as a cheapest path
    repeats no node.
    """
    ns = namespaces or default_namespaces()

    def leaves_() -> DataFrame:
        up = persisted(containers(objects, tuples, ns, max_depth), "up")
        grants = direct_grants(tuples, ns, relation).withColumnRenamed("object", "container")
        return persisted(up.join(grants, "container").groupBy("object", "subject").agg(F.min("depth").alias("depth")), "leaves")

    leaves, members = side_by_side(leaves_, lambda: principal_closure(tuples, ns, max_depth).select("principal", F.col("userset").alias("subject"), "hop"))
    cost = F.col("depth") + F.col("hop")
    return leaves.join(members, "subject").where(cost <= max_depth).groupBy("object", "principal").agg(F.min(cost).alias("cost"))


def why(
    pairs: DataFrame, tuples: DataFrame, namespaces: dict[str, Namespace] | None = None, relation: str = "viewer", max_depth: int = MAX_DEPTH
) -> DataFrame:
    """``object, principal, cost, depth, hop, container, subject`` of the allowed ones of the given
    ``object, principal`` pairs: the cheapest way, which leads over ``depth`` containers to ``container``,
    whose tuple names ``subject``, of which the principal is a member by ``hop`` hops. Of equal ways
    the one of the least depth, then container, then subject.

    It goes from both ends: only the objects and principals of the pairs are walked, and rows are
    made only for them.
    """
    ns = namespaces or default_namespaces()
    pairs = persisted(pairs.select("object", "principal").distinct(), "pairs")
    grants = direct_grants(tuples, ns, relation).withColumnRenamed("object", "container")
    asked = pairs.select("principal").distinct()

    def leaves_() -> DataFrame:
        up = containers(pairs.select("object").distinct(), tuples, ns, max_depth)
        ways = up.join(grants, "container").groupBy("object", "subject").agg(F.min(F.struct("depth", "container")).alias("way"))
        return persisted(ways.select("object", "subject", "way.*"), "leaves")

    leaves, members = side_by_side(leaves_, lambda: closure_of(asked, tuples, ns, max_depth).select("principal", F.col("userset").alias("subject"), "hop"))
    cost = F.col("depth") + F.col("hop")
    allowed = pairs.join(leaves, "object").join(members, ["principal", "subject"]).where(cost <= max_depth)
    best = F.min(F.struct(cost.alias("cost"), "depth", "container", "subject", "hop")).alias("w")
    return allowed.groupBy("object", "principal").agg(best).select("object", "principal", "w.cost", "w.depth", "w.hop", "w.container", "w.subject")


def check_hits(
    pairs: DataFrame, tuples: DataFrame, namespaces: dict[str, Namespace] | None = None, relation: str = "viewer", max_depth: int = MAX_DEPTH
) -> DataFrame:
    """``object, principal, cost`` of the allowed ones of the given ``object, principal`` pairs, as
    ``check_pairs`` but from both ends."""
    return why(pairs, tuples, namespaces, relation, max_depth).select("object", "principal", "cost")


def closure_of(asked: DataFrame, tuples: DataFrame, namespaces: dict[str, Namespace], depth: int = SUBJECT_DEPTH) -> DataFrame:
    """``principal, userset, hop`` of the concrete principals ``asked`` (``principal``), themselves at hop 0
    also where no tuple names them."""
    inner = persisted(userset_closure(tuples, namespaces, depth), "closure")
    mine = tuples.where("principal_rel = ''").join(asked.select(F.col("principal").alias("__who")), principal_ref() == F.col("__who"), "left_semi")
    direct = membership_edges(mine, subject_keys(tuples), namespaces)
    reached = direct.join(inner, F.col("dst") == F.col("root")).select(F.col("src").alias("principal"), F.col("node").alias("userset"), (F.col("hop") + 1).alias("hop"))
    own = asked.select("principal", F.col("principal").alias("userset"), F.lit(0).alias("hop"))
    return own.unionByName(reached.where(F.col("hop") <= depth)).groupBy("principal", "userset").agg(F.min("hop").alias("hop"))


class Reach:
    """What every principal reaches, by the set of its usersets.

    ``sets``: ``principal, key`` (equal for equal sets of usersets); ``by_key``: ``key, object`` of
    what a set reaches; ``own``: ``principal, object`` of what only the principal's own grants reach.
    No row is made per principal and object of a shared set. With the ``closure`` of some principals
    only what they are granted is walked.
    """

    def __init__(self, tuples: DataFrame, namespaces: dict[str, Namespace] | None = None, relation: str = "viewer", ns_wanted: str = "doc", closure: DataFrame | None = None):
        ns, few = namespaces or default_namespaces(), closure is not None
        self.closure = closure = persisted(closure if few else principal_closure(tuples, ns), "closures")
        # The principal itself is a grantor of its own; the usersets make the shared part.
        sets = closure.where("hop > 0").groupBy("principal").agg(F.array_sort(F.collect_set("userset")).alias("usersets"))
        sets = persisted(sets.withColumn("key", F.sha2(F.to_json("usersets"), 256)), "sets")
        self.sets = sets.select("principal", "key")
        down = containment_edges(tuples, ns, relation).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        grants = direct_grants(tuples, ns, relation)
        if few:
            grants = grants.join(closure.select(F.col("userset").alias("subject")).distinct(), "subject", "left_semi")
        grants = persisted(grants, "grants")
        # only what contains something is walked
        roots = grants.select(F.col("object").alias("root")).distinct()
        holders = roots.join(down.select(F.col("src").alias("root")).distinct(), "root", "left_semi")
        below = walk(holders.select("root", F.col("root").alias("node")), down, OBJECT_DEPTH, "below").where("hop > 0")
        granted = grants.select("subject", "object").unionByName(grants.join(below, F.col("object") == F.col("root")).select("subject", F.col("node").alias("object")))
        granted = persisted(granted.where(F.col("object").startswith(f"{ns_wanted}:")).distinct(), "granted")
        shared = sets.select("key", "usersets").dropDuplicates(["key"]).select("key", F.explode("usersets").alias("subject"))
        self.by_key = persisted(shared.join(granted, "subject").select("key", "object").distinct(), "bykey")
        own = closure.where("hop = 0").select("principal", F.col("userset").alias("subject")).join(granted, "subject").select("principal", "object")
        self.own = persisted(own.join(self.sets, "principal", "left").join(self.by_key, ["key", "object"], "left_anti").select("principal", "object"), "own")

    def counts(self) -> DataFrame:
        """``principal, n`` of the principals that reach something."""
        shared = self.sets.join(self.by_key.groupBy("key").agg(F.count("*").alias("n")), "key").select("principal", "n")
        return shared.unionByName(self.own.groupBy("principal").agg(F.count("*").alias("n"))).groupBy("principal").agg(F.sum("n").alias("n"))

    def objects(self, principals: DataFrame | None = None) -> DataFrame:
        """``principal, object`` of the given principals, or of all."""
        sets, own = self.sets, self.own
        if principals is not None:
            sets, own = (x.join(principals.select("principal"), "principal", "left_semi") for x in (sets, own))
        return sets.join(self.by_key, "key").select("principal", "object").unionByName(own)


def reachable_objects(tuples: DataFrame, namespaces: dict[str, Namespace] | None = None, relation: str = "viewer", ns_wanted: str = "doc") -> DataFrame:
    """``principal, object``: what the grantors of each principal's closure are granted, and what
    these objects contain, down to the object depth. Every pair is a row; ``Reach`` counts without."""
    return Reach(tuples, namespaces, relation, ns_wanted).objects()


def recheck(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """Hits (``principal, object_ref``) with ``kept``: whether the live tuples allow the object.

    ``allowed`` is ``object, principal`` of ``check_pairs``. A malformed reference is dropped.
    """
    live = allowed.select(F.col("object").alias("object_ref"), "principal").withColumn("__live", F.lit(True))
    return hits.join(live, ["object_ref", "principal"], "left").withColumn("kept", F.coalesce("__live", F.lit(False))).drop("__live")
