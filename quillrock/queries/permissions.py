"""Queries on the tuples: statistics, closures, expansion, checks, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillrock.model import object_ref, parse_tuples, principal_ref, tuple_text
from quillrock.operators import graph, policystore
from quillrock.plans import compiler
from quillrock.plans.rewrite import default_namespaces, implies_rows
from quillrock.session import persisted, side_by_side, table


def _tuples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tuples")


def _policy(spark: SparkSession, sf: str) -> DataFrame:
    """The tuples with containment in one spelling, for walks that read it one way."""
    return graph.oriented(_tuples(spark, sf))


def _joined(c: str):
    return F.array_join(F.array_sort(c), ",")


def tuple_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Every tuple written as text and read back, and the roster's principals as malformed ones."""
    texts = _tuples(spark, sf).select(tuple_text().alias("text")).unionByName(table(spark, sf, "roster").select(F.col("principal").alias("text")))
    return parse_tuples(texts)


def tuple_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Owners lose their grants and become editors: deletes first, then writes."""
    t = _tuples(spark, sf)
    owners = t.where("relation = 'owner'")
    return policystore.merged(t, owners.withColumn("relation", F.lit("editor")), owners)


def tuple_apply_count(spark: SparkSession, sf: str) -> DataFrame:
    t = _tuples(spark, sf)
    owners = t.where("relation = 'owner'")
    return policystore.n_applied(t, owners.withColumn("relation", F.lit("editor")), owners)


def tuple_stats(spark: SparkSession, sf: str) -> DataFrame:
    return policystore.stats(_tuples(spark, sf))


def tuple_read_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The forward index: tuples of the objects that hold a folder as parent."""
    t = _tuples(spark, sf)
    wanted = t.where("relation = 'parent' and object_ns = 'doc'").select("object_ns", "object_id").distinct()
    return t.join(wanted, ["object_ns", "object_id"], "left_semi").select(tuple_text().alias("tuple"))


def tuple_read_reverse(spark: SparkSession, sf: str) -> DataFrame:
    """The reverse index: tuples per exact principal, by relation."""
    return _tuples(spark, sf).groupBy(principal_ref().alias("principal"), "relation").agg(F.count("*").alias("n"))


def list_objects(spark: SparkSession, sf: str) -> DataFrame:
    return _tuples(spark, sf).groupBy("object_ns").agg(F.count_distinct("object_id").alias("n_objects"))


def subject_keys(spark: SparkSession, sf: str) -> DataFrame:
    return graph.subject_keys(_tuples(spark, sf))


def implied_relations(spark: SparkSession, sf: str) -> DataFrame:
    return graph.held_relations(_tuples(spark, sf), default_namespaces()).groupBy("object_ns", "target_rel").agg(F.count("*").alias("n"))


def closure_hops(spark: SparkSession, sf: str) -> DataFrame:
    return graph.principal_closure(_policy(spark, sf)).select("principal", "userset", F.col("hop").cast("int").alias("hop"))


def expand_leaves(spark: SparkSession, sf: str) -> DataFrame:
    t = _policy(spark, sf)
    return graph.expand_leaves(graph.objects_of(t), t).select("object", "subject", F.col("depth").cast("int").alias("depth"))


def expand_nodes(spark: SparkSession, sf: str) -> DataFrame:
    t = _policy(spark, sf)
    return graph.expand_nodes(graph.objects_of(t), t).select("object", "node", F.col("depth").cast("int").alias("depth"), "relation", _joined("subjects").alias("subjects"))


def expand_symmetric(spark: SparkSession, sf: str) -> DataFrame:
    """Containment read both ways, in whichever spelling it comes: siblings share their grants."""
    t = _tuples(spark, sf)
    return graph.expand_leaves(graph.objects_of(t), t, default_namespaces(True)).select("object", "subject", F.col("depth").cast("int").alias("depth"))


def check_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """How many principals may view each document, and at what cost."""
    t = _policy(spark, sf)
    pairs = graph.check_pairs(graph.objects_of(t), t)
    return pairs.groupBy("object").agg(F.count("*").alias("n_allowed"), F.min("cost").cast("int").alias("least_cost"), F.max("cost").cast("int").alias("most_cost"))


def check_costs(spark: SparkSession, sf: str) -> DataFrame:
    """Per principal the allowed documents by cost."""
    t = _policy(spark, sf)
    pairs = graph.check_pairs(graph.objects_of(t), t)
    return pairs.groupBy("principal", F.col("cost").cast("int").alias("cost")).agg(F.count("*").alias("n"))


def check_explain(spark: SparkSession, sf: str) -> DataFrame:
    """Why each staff member may view the documents that stand with them in a tuple, and some of the next
    member's: the way that allows it, or none."""
    t = _policy(spark, sf)
    docs = t.where("object_ns = 'doc' and principal_ns = 'user'").select(object_ref().alias("object"), principal_ref().alias("principal"))
    staff = table(spark, sf, "roster").select("principal").distinct().withColumn("next", F.lead("principal").over(Window.orderBy("principal")))  # 400 staff
    asked = docs.unionByName(docs.join(F.broadcast(staff), "principal").where("next is not null").select("object", F.col("next").alias("principal"))).distinct()
    asked = persisted(asked, "asked")
    found = graph.why(asked, t)
    return asked.join(found, ["object", "principal"], "left").select(
        "object", "principal", F.col("cost").isNotNull().alias("allowed"), *[F.col(c).cast("int").alias(c) for c in ("cost", "depth", "hop")], "container", "subject"
    )


def check_depth_limits(spark: SparkSession, sf: str) -> DataFrame:
    """Allowed pairs under depth limits 1, 2, 4, 8 and 16."""
    t = _policy(spark, sf)
    pairs = persisted(graph.check_pairs(graph.objects_of(t), t), "checks")
    limits = spark.createDataFrame([(x,) for x in (1, 2, 4, 8, 16)], "max_depth int")
    return pairs.join(F.broadcast(limits), F.col("cost") <= F.col("max_depth")).groupBy("max_depth").agg(F.count("*").alias("n_allowed"))


def reachable_docs(spark: SparkSession, sf: str) -> DataFrame:
    return graph.Reach(_policy(spark, sf)).counts().withColumnRenamed("n", "n_docs")


def _corpus(t: DataFrame) -> int:
    return graph.objects_of(t).count()


def plan_strategy(spark: SparkSession, sf: str) -> DataFrame:
    t = _policy(spark, sf)
    return compiler.compile_plans(t, _corpus(t)).select("principal", "strategy", "estimated_cardinality")


def plan_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = _policy(spark, sf)
    p = compiler.compile_plans(t, _corpus(t))
    return p.select("principal", _joined("grant_tokens").alias("grant_tokens"), _joined("explicit_ids").alias("explicit_ids"))


def stamp_tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = _policy(spark, sf)
    return compiler.stamp_tokens(graph.objects_of(t), t).select("object", _joined("grant_tokens").alias("grant_tokens"))


def oracle_strata(spark: SparkSession, sf: str) -> DataFrame:
    """Plan and token verdicts against the live check, over all principals and documents that either
    allows, by the size of the closure; disagreements are counted, never sampled."""
    t = _policy(spark, sf)
    docs = persisted(graph.objects_of(t), "docs")
    closure = persisted(graph.principal_closure(t), "closures")
    live, plan, leaves = side_by_side(lambda: graph.check_pairs(docs, t), lambda: graph.Reach(t, closure=closure).objects(), lambda: graph.expand_leaves(docs, t))
    live = live.select("object", "principal", F.lit(True).alias("live"))
    plan = plan.select("object", "principal", F.lit(True).alias("planned"))
    leaves = leaves.select("object", F.col("subject").alias("userset"))
    token = closure.join(leaves, "userset").select("object", "principal").distinct().withColumn("tokened", F.lit(True))
    size = closure.groupBy("principal").agg((F.count("*") - 1).alias("n"))
    n = F.col("n")
    stratum = F.when(n == 0, "0").when(n <= 2, "1-2").when(n <= 8, "3-8").when(n <= 32, "9-32").otherwise("33+")
    pairs = live.join(plan, ["object", "principal"], "full").join(token, ["object", "principal"], "full").join(size, "principal")
    flag = lambda c: F.coalesce(c, F.lit(False))
    count = lambda c: F.count_if(c)
    live_, plan_, token_ = (flag(F.col(c)) for c in ("live", "planned", "tokened"))
    return pairs.groupBy(stratum.alias("stratum")).agg(
        count(live_).alias("n_allowed"), count(plan_ & ~live_).alias("plan_false_allow"), count(live_ & ~plan_).alias("plan_false_deny"),
        count(token_ & ~live_).alias("token_false_allow"), count(live_ & ~token_).alias("token_false_deny"),
    )


def retokenised_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents whose token set changes when all editors are removed."""
    t = _policy(spark, sf)
    docs = persisted(graph.objects_of(t), "docs")
    before, after = (compiler.stamp_tokens(docs, x).withColumnRenamed("grant_tokens", n) for x, n in ((t, "before"), (t.where("relation <> 'editor'"), "after")))
    return before.join(after, "object", "full").where(~F.col("before").eqNullSafe(F.col("after"))).select("object", F.size("before").alias("n_before"), F.size("after").alias("n_after"))


def policy_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Tuples of one epoch that the other lacks, both ways, between the table and ``tuple_apply``."""
    a, b = _tuples(spark, sf).select(policystore.KEYS), tuple_apply(spark, sf)
    side = lambda x, y, s: x.exceptAll(y).select(tuple_text().alias("tuple")).withColumn("side", F.lit(s))
    return side(a, b, "removed").unionByName(side(b, a, "added"))


_VALUES = ", ".join(f"('{n}', '{h}', '{t}')" for n, h, t in implies_rows(default_namespaces()))

_SOURCE = "SELECT DISTINCT * FROM tuples"
_TURN = "relation = 'parent' AND object_ns = 'folder' AND principal_ns = 'doc' AND principal_rel = ''"
_ORIENTED = f"""SELECT * FROM tuples WHERE NOT ({_TURN})
  UNION SELECT principal_ns, principal_id, relation, object_ns, object_id, principal_rel FROM tuples WHERE {_TURN}"""
_T0 = f"""implies(ns, held_rel, target_rel) AS (VALUES {_VALUES}),
t AS (SELECT u.*, object_ns || ':' || object_id AS obj,
  principal_ns || ':' || principal_id || CASE WHEN principal_rel <> '' THEN '#' || principal_rel ELSE '' END AS who,
  coalesce(target_rel, relation) AS target
  FROM ({_SOURCE}) u LEFT JOIN implies ON ns = object_ns AND held_rel = relation),
keys AS (SELECT DISTINCT who AS node FROM t WHERE principal_rel <> ''),
docs AS (SELECT DISTINCT obj AS object FROM t WHERE object_ns = 'doc'),
grants AS (SELECT DISTINCT obj AS container, who AS subject FROM t WHERE target = 'viewer')"""
_T = _T0.replace(_SOURCE, _ORIENTED)


def _reach(depth: int) -> str:
    return f"""edges AS (SELECT DISTINCT who AS src, obj || '#' || target AS dst FROM t
  WHERE obj || '#' || target IN (SELECT node FROM keys) AND who <> obj || '#' || target),
reach(root, node, hop) AS (SELECT DISTINCT who, who, 0 FROM t
  UNION SELECT root, dst, hop + 1 FROM reach JOIN edges ON src = node WHERE hop < {depth}),
closure AS (SELECT root AS principal, node AS userset, min(hop) AS hop FROM reach GROUP BY ALL)"""


def _up(depth: int, both: bool = False) -> str:
    back = "UNION SELECT who, obj FROM t WHERE relation = 'parent' AND principal_rel = '' AND principal_ns IN ('doc', 'folder')" if both else ""
    return f"""cedges(src, dst) AS (SELECT obj, principal_ns || ':' || principal_id FROM t WHERE relation = 'parent' AND object_ns IN ('doc', 'folder') {back}),
upw(object, container, depth) AS (SELECT object, object, 0 FROM docs
  UNION SELECT object, dst, depth + 1 FROM upw JOIN cedges ON src = container WHERE depth < {depth} AND src <> dst),
up AS (SELECT object, container, min(depth) AS depth FROM upw GROUP BY ALL),
leaves AS (SELECT object, subject, min(depth) AS depth FROM up JOIN grants USING (container) GROUP BY ALL)"""


_TEXT = "object_ns || ':' || object_id || '#' || relation || '@' || principal_ns || ':' || principal_id || CASE WHEN principal_rel <> '' THEN '#' || principal_rel ELSE '' END"
_CHECK = f"WITH RECURSIVE {_T}, {_reach(16)}, {_up(16)}, pairs AS (SELECT object, principal, min(depth + hop) AS cost FROM leaves JOIN closure ON userset = subject WHERE depth + hop <= 16 GROUP BY ALL) "
_TOKEN = "'gt_' || substr(sha256('{key}|' || {s} || '|viewer'), 1, 32)"
_REACHABLE = """downw(subject, object, depth) AS (SELECT subject, container, 0 FROM grants
  UNION SELECT subject, src, depth + 1 FROM downw JOIN cedges ON dst = object WHERE depth < 8 AND src <> dst),
granted AS (SELECT DISTINCT subject, object FROM downw WHERE object LIKE 'doc:%'),
reachable AS (SELECT DISTINCT principal, object FROM closure JOIN granted ON subject = userset)"""


def _token(s: str) -> str:
    return _TOKEN.format(key=compiler.DEV_KEY, s=s)


_STAMP = lambda where: f"SELECT object, list_sort(list_distinct(list({_token('subject')}))) AS tokens FROM leaves {where} GROUP BY object"
_PLAN = f"""WITH RECURSIVE {_T}, {_reach(8)}, {_up(8)}, {_REACHABLE},
corpus AS (SELECT count(*) AS c FROM docs),
n AS (SELECT principal, count(object) AS n, list_sort(list(object)) AS ids FROM (SELECT DISTINCT principal FROM closure) LEFT JOIN reachable USING (principal) GROUP BY principal),
plan AS (SELECT principal, n, ids, c, least({compiler.ENUMERATION_CAP}, greatest({compiler.EXACT_SCAN_MAX + 1}, c + 1)) AS cap FROM n, corpus),
plans AS (SELECT principal, least(n, cap) AS estimated_cardinality, ids,
  CASE WHEN n = 0 THEN 'enumerate' WHEN n <= cap AND c > 0 AND n >= c THEN 'unfiltered' WHEN n > cap THEN 'grant_tokens'
       WHEN n <= {compiler.ENUMERATE_MAX} THEN 'enumerate' WHEN n <= {compiler.EXACT_SCAN_MAX} THEN 'exact_scan' ELSE 'grant_tokens' END AS strategy FROM plan) """

QUERIES = {
    f.__name__: f
    for f in (
        tuple_parse, tuple_apply, tuple_apply_count, tuple_stats, tuple_read_forward, tuple_read_reverse, list_objects, subject_keys, implied_relations,
        closure_hops, expand_leaves, expand_nodes, expand_symmetric, check_matrix, check_costs, check_explain, check_depth_limits, reachable_docs, plan_strategy,
        plan_tokens, stamp_tokens, oracle_strata, retokenised_docs, policy_delta,
    )
}

_APPLIED = """owners AS (SELECT * FROM tuples WHERE relation = 'owner'),
left_ AS (SELECT * FROM tuples EXCEPT SELECT * FROM owners),
written AS (SELECT object_ns, object_id, 'editor' AS relation, principal_ns, principal_id, principal_rel FROM owners)"""

SQL = {
    "tuple_parse": f"""SELECT {_TEXT} AS text, object_ns, object_id, relation, principal_ns, principal_id, principal_rel, true AS valid FROM tuples
      UNION ALL SELECT principal, NULL, NULL, NULL, NULL, NULL, NULL, false FROM roster""",
    "tuple_apply": f"WITH {_APPLIED} SELECT * FROM left_ UNION SELECT * FROM written",
    "tuple_apply_count": f"WITH {_APPLIED} SELECT (SELECT count(*) FROM owners) + (SELECT count(*) FROM (SELECT * FROM written EXCEPT SELECT * FROM left_)) AS n_applied",
    "tuple_stats": "SELECT count(*) AS tuples, count(DISTINCT (object_ns, object_id)) AS objects, count(DISTINCT (principal_ns, principal_id, principal_rel)) AS principals, CAST(0 AS BIGINT) AS epoch FROM tuples",
    "tuple_read_forward": f"SELECT {_TEXT} AS tuple FROM tuples WHERE (object_ns, object_id) IN (SELECT (object_ns, object_id) FROM tuples WHERE relation = 'parent' AND object_ns = 'doc')",
    "tuple_read_reverse": f"WITH {_T0} SELECT who AS principal, relation, count(*) AS n FROM (SELECT DISTINCT obj, relation, who FROM t) GROUP BY ALL",
    "list_objects": "SELECT object_ns, count(DISTINCT object_id) AS n_objects FROM tuples GROUP BY ALL",
    "subject_keys": f"WITH {_T0} SELECT node FROM keys",
    "implied_relations": f"WITH {_T0} SELECT object_ns, target AS target_rel, count(*) AS n FROM t GROUP BY ALL",
    "closure_hops": f"WITH RECURSIVE {_T}, {_reach(8)} SELECT principal, userset, hop FROM closure",
    "expand_leaves": f"WITH RECURSIVE {_T}, {_up(8)} SELECT object, subject, depth FROM leaves",
    "expand_nodes": f"""WITH RECURSIVE {_T}, {_up(8)} SELECT object, container AS node, depth, relation, array_to_string(list_sort(list(DISTINCT who)), ',') AS subjects
      FROM up JOIN t ON obj = container WHERE target = 'viewer' GROUP BY ALL""",
    "expand_symmetric": f"WITH RECURSIVE {_T0}, {_up(8, True)} SELECT object, subject, depth FROM leaves",
    "check_matrix": _CHECK + "SELECT object, count(*) AS n_allowed, min(cost) AS least_cost, max(cost) AS most_cost FROM pairs GROUP BY object",
    "check_costs": _CHECK + "SELECT principal, cost, count(*) AS n FROM pairs GROUP BY ALL",
    "check_explain": _CHECK
    + """, own AS (SELECT DISTINCT obj AS object, who AS principal FROM t WHERE object_ns = 'doc' AND principal_ns = 'user'),
      staff AS (SELECT principal, lead(principal) OVER (ORDER BY principal) AS next FROM (SELECT DISTINCT principal FROM roster)),
      asked AS (SELECT * FROM own UNION SELECT object, next FROM own JOIN staff USING (principal) WHERE next IS NOT NULL),
      members AS (SELECT principal, userset, hop FROM closure UNION SELECT principal, principal, 0 FROM asked),
      ways AS (SELECT a.object, a.principal, w.depth + m.hop AS cost, w.depth, m.hop, w.container, w.subject FROM asked a
        JOIN (SELECT object, container, subject, depth FROM up JOIN grants USING (container)) w ON w.object = a.object JOIN members m ON m.principal = a.principal AND m.userset = w.subject WHERE w.depth + m.hop <= 16),
      best AS (SELECT *, row_number() OVER (PARTITION BY object, principal ORDER BY cost, depth, container, subject) AS k FROM ways)
      SELECT a.object, a.principal, cost IS NOT NULL AS allowed, cost, depth, hop, container, subject FROM asked a LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON b.object = a.object AND b.principal = a.principal""",
    "check_depth_limits": _CHECK + "SELECT max_depth, count(*) AS n_allowed FROM pairs JOIN (VALUES (1), (2), (4), (8), (16)) l(max_depth) ON cost <= max_depth GROUP BY max_depth",
    "reachable_docs": f"WITH RECURSIVE {_T}, {_reach(8)}, {_up(8)}, {_REACHABLE} SELECT principal, count(*) AS n_docs FROM reachable GROUP BY principal",
    "plan_strategy": _PLAN + "SELECT principal, strategy, estimated_cardinality FROM plans",
    "plan_tokens": _PLAN
    + f"""SELECT principal, (SELECT array_to_string(list_sort(list(DISTINCT {_token("userset")})), ',') FROM closure k WHERE k.principal = p.principal) AS grant_tokens,
      CASE WHEN strategy IN ('enumerate', 'exact_scan') THEN coalesce(array_to_string(list_filter(ids, lambda x: x IS NOT NULL), ','), '') ELSE '' END AS explicit_ids FROM plans p""",
    "stamp_tokens": f"WITH RECURSIVE {_T}, {_up(8)}, s AS ({_STAMP('')}) SELECT object, coalesce(array_to_string(tokens, ','), '') AS grant_tokens FROM docs LEFT JOIN s USING (object)",
    "oracle_strata": _CHECK.replace("pairs AS", "live AS")
    + f""", closure8 AS (SELECT principal, userset FROM closure WHERE hop <= 8), leaves8 AS (SELECT object, subject FROM leaves WHERE depth <= 8),
      {_REACHABLE.replace('FROM closure JOIN', 'FROM closure8 JOIN')},
      token AS (SELECT DISTINCT object, principal FROM closure8 JOIN leaves8 ON subject = userset),
      size AS (SELECT principal, count(*) - 1 AS n FROM closure8 GROUP BY principal),
      every AS (SELECT object, principal FROM live UNION SELECT object, principal FROM reachable UNION SELECT object, principal FROM token),
      v AS (SELECT e.*, n, l.object IS NOT NULL AS li, r.object IS NOT NULL AS pl, k.object IS NOT NULL AS tk FROM every e JOIN size USING (principal)
        LEFT JOIN live l ON l.object = e.object AND l.principal = e.principal LEFT JOIN reachable r ON r.object = e.object AND r.principal = e.principal
        LEFT JOIN token k ON k.object = e.object AND k.principal = e.principal)
      SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' WHEN n <= 8 THEN '3-8' WHEN n <= 32 THEN '9-32' ELSE '33+' END AS stratum,
        CAST(count(*) FILTER (li) AS BIGINT) AS n_allowed, count(*) FILTER (pl AND NOT li) AS plan_false_allow, count(*) FILTER (li AND NOT pl) AS plan_false_deny,
        count(*) FILTER (tk AND NOT li) AS token_false_allow, count(*) FILTER (li AND NOT tk) AS token_false_deny FROM v GROUP BY 1""",
    "retokenised_docs": f"""WITH RECURSIVE {_T}, {_up(8)},
      grants2 AS (SELECT DISTINCT obj AS container, who AS subject FROM t WHERE target = 'viewer' AND relation <> 'editor'),
      b AS (SELECT object, list_sort(list(DISTINCT subject)) AS s FROM leaves GROUP BY object),
      a AS (SELECT object, list_sort(list(DISTINCT subject)) AS s FROM up JOIN grants2 USING (container) GROUP BY object)
      SELECT object, coalesce(len(b.s), 0)::INT AS n_before, coalesce(len(a.s), 0)::INT AS n_after FROM docs LEFT JOIN b USING (object) LEFT JOIN a USING (object) WHERE b.s IS DISTINCT FROM a.s""",
    "policy_delta": f"""WITH {_APPLIED}, b AS (SELECT * FROM left_ UNION SELECT * FROM written)
      SELECT {_TEXT} AS tuple, 'removed' AS side FROM (SELECT * FROM tuples EXCEPT SELECT * FROM b) UNION ALL SELECT {_TEXT}, 'added' FROM (SELECT * FROM b EXCEPT SELECT * FROM tuples)""",
}
