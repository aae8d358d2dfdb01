"""Queries on reports: verdicts with totals and rates, selectivity arms, gates, counters, claims, fills."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrock.functions import guard
from quillrock.functions import textmetrics as tm
from quillrock.operators import audit, graph, ingest
from quillrock.operators.search import permitted_pairs
from quillrock.plans import compiler
from quillrock.queries import guarding, permissions, searching
from quillrock.session import persisted, table

#: Price of a thousand tokens, by rung; an extractive answer costs nothing, a refusal has no price.
PRICES = {"full": 0.0005, "extractive": 0.0}
#: (prefix of a metric, tolerance): the longest prefix that fits is a metric's gate.
GATES = (("", 0.0), ("index.", 0.05), ("index.n_chunks", 0.5), ("oracle.", 0.0), ("texts.", 0.02))


def oracle_report(spark: SparkSession, sf: str) -> DataFrame:
    """The strata of ``oracle_strata`` with their total, rates over what the check allows, and the verdict."""
    s = permissions.oracle_strata(spark, sf)
    counts = [c for c in s.columns if c != "stratum"]
    r = s.rollup("stratum").agg(*[F.sum(c).alias(c) for c in counts])
    rate = lambda c: F.when(F.col("n_allowed") > 0, F.round(F.col(c) / F.col("n_allowed"), 9)).otherwise(0.0)
    return r.select(
        F.coalesce("stratum", F.lit("total")).alias("stratum"), *counts, rate("plan_false_deny").alias("plan_deny_rate"), rate("token_false_deny").alias("token_deny_rate"),
        ((F.col("plan_false_allow") == 0) & (F.col("token_false_allow") == 0)).alias("passed"),
    )


def plan_bindings(spark: SparkSession, sf: str) -> DataFrame:
    """What each compiled plan binds, whether it admits nothing, and whether it is stale one epoch later."""
    t = permissions._policy(spark, sf)
    p = compiler.compile_plans(t, graph.objects_of(t).count())
    s, tokens, ids = F.col("strategy"), F.col("grant_tokens"), F.col("explicit_ids")
    by_tokens, by_ids = compiler.bindings(s, tokens, ids)
    return p.select(
        "principal", by_tokens.alias("by_tokens"), by_ids.alias("by_ids"), compiler.admits_nothing(s, tokens, ids).alias("nothing"), compiler.is_stale(F.col("epoch"), 1).alias("stale"),
        compiler.clamp_k(F.size(tokens), 5).alias("k"),
    )


def count_matching(spark: SparkSession, sf: str) -> DataFrame:
    """How many chunks the compiled plan of each who asks admits."""
    chunks, asked, plans = searching._planned(spark, sf)
    n = chunks.count()
    bound = permitted_pairs(chunks, plans).groupBy("principal").agg(F.count("*").alias("n"))
    every = plans.select("principal", "strategy").join(bound, "principal", "left")
    return every.select("principal", F.when(F.col("strategy") == "unfiltered", F.lit(n)).otherwise(F.coalesce("n", F.lit(0))).cast("bigint").alias("n_chunks"))


def retrieved_not_shown(spark: SparkSession, sf: str) -> DataFrame:
    """Objects that a stale index retrieved and the recheck did not let through, per query."""
    chunks, asked, queries = searching._permitted(spark, sf)
    hits = persisted(searching._searched(chunks, queries, searching.K), "hits")
    named = hits.join(chunks.select("row_id", "object_ref"), "row_id").join(asked.select("query_id", "principal"), "query_id")
    live = searching._policy(spark, sf).where("relation <> 'editor'")
    named = persisted(named, "named")
    checked = graph.recheck(named, graph.check_hits(named.select(F.col("object_ref").alias("object"), "principal"), live))
    sets = checked.groupBy("query_id").agg(F.collect_set("object_ref").alias("retrieved"), F.collect_set(F.when(F.col("kept"), F.col("object_ref"))).alias("shown"))
    hidden = F.array_except("retrieved", "shown")
    return sets.select("query_id", F.size("retrieved").alias("n_retrieved"), F.size("shown").alias("n_shown"), F.size(hidden).alias("n_hidden"), F.array_join(F.array_sort(hidden), ",").alias("hidden"))


def event_counters(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("half", F.when(F.hour("ts") < 12, "am").otherwise("pm"))
    return audit.counters(e, ["event_type", "half"], F.ceil(F.abs("value")).cast("bigint"))


def scan_retrieved(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of each object that the wired-in rules flag."""
    c = table(spark, sf, "chunks").where("object_ref is not null").dropDuplicates(["object_ref", "chunk_id", "text"])
    r = guard.scan_report(c, "object_ref")
    return r.select("object_ref", "n_flagged", F.array_join("flagged", ",").alias("flagged"), "first_rule", "chars")


def greedy_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The passages of each object that fit into 120 tokens, the shortest ids first: what does not fit is
    skipped, and later ones may still fit."""
    c = table(spark, sf, "chunks").where("object_ref is not null and text is not null").select("object_ref", "row_id", tm.generation_tokens(F.col("text")).alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("row_id", "n")))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda acc, p: F.when(
        acc["used"] + p["n"] <= 120, F.struct((acc["used"] + p["n"]).alias("used"), F.concat(acc["kept"], F.array(p["row_id"])).alias("kept"))
    ).otherwise(acc)
    f = c.groupBy("object_ref").agg(F.aggregate(listed, zero, step).alias("f"))
    return f.select("object_ref", F.col("f.used").alias("tokens"), F.array_join("f.kept", ",").alias("kept"))


def dropped_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Ids that an object's texts cite beside its own chunks: how many vanish, and whether any is left."""
    c = table(spark, sf, "chunks").where("object_ref is not null")
    own = c.groupBy("object_ref").agg(F.collect_set("chunk_id").alias("known"))
    cited = c.groupBy("object_ref").agg(F.collect_set(F.when(F.col("row_id") % 3 == 0, F.concat("chunk_id", F.lit("?"))).otherwise(F.col("chunk_id"))).alias("cited"))
    j = own.join(cited, "object_ref")
    return j.select("object_ref", F.size(F.array_except("cited", "known")).alias("dropped"), F.arrays_overlap("cited", "known").alias("grounded"))


def usd_estimates(spark: SparkSession, sf: str) -> DataFrame:
    """The price of an answer from all chunks of an object; null where there is none."""
    c = table(spark, sf, "chunks").where("object_ref is not null").groupBy("object_ref").agg(F.count("text").alias("n"), (F.sum(F.coalesce(F.length("text"), F.lit(0))) + tm.CONTEXT_OVERHEAD * F.count("text")).alias("chars"))
    rung = tm.budget_rung(F.col("n"), F.col("chars"), F.lit("what is said here?"))
    tokens = F.ceil(F.col("chars") / tm.CHARS_PER_TOKEN) + tm.EXPECTED_OUTPUT_TOKENS
    price = F.when(rung == "full", PRICES["full"]).when(rung == "extractive", PRICES["extractive"])
    return c.select("object_ref", F.round(tokens / 1000 * price, 9).alias("usd"))


def embedding_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Embedding with a cache that holds every text of an even row: cached, computed and equal ones."""
    c = table(spark, sf, "chunks").where("text is not null").select("row_id", "text", ingest.text_key(F.col("text"), 64).alias("key"))
    cache = persisted(ingest.embedded(c.where("row_id % 2 = 0"), None, 64), "cache")
    fresh = persisted(ingest.embedded(c, cache.select("key"), 64), "fresh")
    joined = c.join(cache.unionByName(fresh), "key")
    n = joined.agg(F.count("*").alias("texts"), F.count_if(F.size("embedding") == 64).alias("embedded"), F.count_distinct("key").alias("distinct"))
    return n.crossJoin(fresh.agg(F.count("*").alias("computed"))).select("texts", "embedded", "computed", (F.col("distinct") - F.col("computed")).alias("cached"), (F.col("texts") - F.col("distinct")).alias("deduplicated"))  # one row each


def grounded_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Answers cut into sentences as claims on their passage: those with enough support are kept; an item
    without any is ungrounded."""
    e = table(spark, sf, "eval_items").select("item_id", "passage", F.posexplode(F.split(F.coalesce("answer", F.lit("")), r"[.!?] ")).alias("n", "claim"))
    s = tm.support_score(F.col("claim"), F.col("passage")) >= tm.MIN_SUPPORT
    g = e.withColumn("kept", s).groupBy("item_id").agg(F.count("*").alias("n_claims"), F.count_if("kept").alias("n_kept"))
    return g.select("item_id", "n_claims", "n_kept", F.when(F.col("n_kept") > 0, "answered").otherwise("ungrounded").alias("verdict"))


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """``metric, value``: the results of several queries, flattened."""
    c, d = table(spark, sf, "chunks"), table(spark, sf, "documents")
    index = c.agg(F.count("*").alias("index.n_rows"), F.count_distinct("chunk_id").alias("index.n_chunks"), F.count_distinct("object_ref").alias("index.n_objects"))
    texts = d.agg(F.count("text").alias("texts.n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("texts.chars"))
    flat = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(f"`{x}`").cast("double").alias("value")) for x in df.columns])))
    return flat(index).unionByName(flat(texts))


def drift_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Each metric against a run over the even rows only, under the gate of its longest prefix."""
    c, d = table(spark, sf, "chunks").where("row_id % 2 = 0"), table(spark, sf, "documents").where("doc_id % 2 = 0")
    half = c.agg(F.count("*").cast("double").alias("r"), F.count_distinct("chunk_id").cast("double").alias("c"), F.count_distinct("object_ref").cast("double").alias("o"))
    half = half.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(x).alias("committed")) for m, x in (("index.n_rows", "r"), ("index.n_chunks", "c"), ("index.n_objects", "o"))])))
    t = d.agg(F.count("text").cast("double").alias("n"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("s"))
    half = half.unionByName(t.select(F.inline(F.array(F.struct(F.lit("texts.n").alias("metric"), F.col("n").alias("committed")), F.struct(F.lit("texts.chars").alias("metric"), F.col("s").alias("committed"))))))
    gates = spark.createDataFrame(list(GATES), "prefix string, tolerance double")
    j = run_metrics(spark, sf).join(half, "metric").join(F.broadcast(gates), F.col("metric").startswith(F.col("prefix")))  # five gates
    best = j.groupBy("metric", "value", "committed").agg(F.max_by(F.struct("prefix", "tolerance"), F.length("prefix")).alias("g"))
    drift = F.abs(F.col("value") - F.col("committed")) / F.greatest(F.col("committed"), F.lit(1.0))
    return best.select("metric", F.col("g.prefix").alias("gate"), F.round(drift, 9).alias("drift"), (drift > F.col("g.tolerance")).alias("breached"))


def selectivity_report(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the filtered arm holds its floor, and the worst recall of the others, over the densities."""
    r = searching.recall_by_density(spark, sf)
    floor = F.min(F.when(F.col("arm") == "filtered", F.col("recall")))
    return r.agg(floor.alias("filtered_floor"), (floor >= 0.95).alias("floor_holds"), F.min(F.when(F.col("arm") == "post_x1", F.col("recall"))).alias("worst_post_x1"), F.min(F.when(F.col("arm") == "post_x10", F.col("recall"))).alias("worst_post_x10"))


QUERIES = {
    f.__name__: f
    for f in (
        oracle_report, plan_bindings, count_matching, retrieved_not_shown, event_counters, scan_retrieved, greedy_fill, dropped_citations, usd_estimates, embedding_stats,
        grounded_claims, run_metrics, drift_gates, selectivity_report,
    )
}


def _sql() -> dict[str, str]:
    p, g, s = permissions.SQL, guarding.SQL, searching.SQL
    planned = s["search_planned"][: s["search_planned"].rindex("SELECT query_id, CAST(rank")]
    hits = s["recheck_hits"][: s["recheck_hits"].rindex("SELECT query_id, count(*)")]
    chars = "SELECT object_ref, count(text) AS n, sum(coalesce(length(text), 0)) + {0} * count(text) AS chars FROM chunks WHERE object_ref IS NOT NULL GROUP BY object_ref".format(tm.CONTEXT_OVERHEAD)
    claims = guarding._SUPPORT.replace("concat_ws(' ', question, answer)", "claim").replace("FROM eval_items", "FROM claims").replace("item_id, ", "item_id, n, ")
    metrics = """m AS (SELECT 'index.n_rows' AS metric, count(*)::DOUBLE AS value FROM {c} UNION ALL SELECT 'index.n_chunks', count(DISTINCT chunk_id) FROM {c} UNION ALL SELECT 'index.n_objects', count(DISTINCT object_ref) FROM {c}
      UNION ALL SELECT 'texts.n', count(text) FROM {d} UNION ALL SELECT 'texts.chars', sum(coalesce(length(text), 0)) FROM {d})"""
    every, half = metrics.format(c="chunks", d="documents"), metrics.format(c="(SELECT * FROM chunks WHERE row_id % 2 = 0)", d="(SELECT * FROM documents WHERE doc_id % 2 = 0)").replace("m AS", "h AS")
    gates = ", ".join(f"('{a}', {b})" for a, b in GATES)
    return {
        "oracle_report": f"""SELECT coalesce(stratum, 'total') AS stratum, CAST(sum(n_allowed) AS BIGINT) AS n_allowed, CAST(sum(plan_false_allow) AS BIGINT) AS plan_false_allow, CAST(sum(plan_false_deny) AS BIGINT) AS plan_false_deny,
          CAST(sum(token_false_allow) AS BIGINT) AS token_false_allow, CAST(sum(token_false_deny) AS BIGINT) AS token_false_deny,
          CASE WHEN sum(n_allowed) > 0 THEN round(sum(plan_false_deny) / sum(n_allowed), 9) ELSE 0 END::DOUBLE AS plan_deny_rate, CASE WHEN sum(n_allowed) > 0 THEN round(sum(token_false_deny) / sum(n_allowed), 9) ELSE 0 END::DOUBLE AS token_deny_rate,
          sum(plan_false_allow) = 0 AND sum(token_false_allow) = 0 AS passed FROM ({p['oracle_strata']}) GROUP BY ROLLUP (stratum)""",
        "plan_bindings": permissions._PLAN
        + """SELECT principal, strategy <> 'unfiltered' AS by_tokens, strategy = 'enumerate' OR strategy = 'exact_scan' AS by_ids, strategy = 'enumerate' AND estimated_cardinality = 0 AS nothing, true AS stale,
          CAST(greatest(1, least(5, (SELECT count(DISTINCT userset) FROM closure k WHERE k.principal = plans.principal))) AS INTEGER) AS k FROM plans""",
        "count_matching": planned.replace("p AS (SELECT s.*", "allc AS (SELECT chunks.object_ref, coalesce(tokens, []) AS tokens FROM chunks LEFT JOIN ct USING (object_ref)), who AS (SELECT DISTINCT principal, qt FROM q), p AS (SELECT s.*")
        + "SELECT plan.principal, CAST(sum(CASE WHEN strategy = 'unfiltered' OR (list_has_any(tokens, qt) AND (strategy = 'grant_tokens' OR list_contains(ids, object_ref))) THEN 1 ELSE 0 END) AS BIGINT) AS n_chunks FROM plan JOIN who USING (principal), allc GROUP BY plan.principal",
        "retrieved_not_shown": hits
        + """, x AS (SELECT query_id, f.object_ref AS o, live.object_ref IS NOT NULL AS kept FROM f LEFT JOIN live ON live.object_ref = f.object_ref AND live.principal = f.principal WHERE rank <= 10),
          y AS (SELECT query_id, count(DISTINCT o) AS r, count(DISTINCT o) FILTER (kept) AS k, list_sort(list(DISTINCT o) FILTER (o IS NOT NULL AND NOT kept)) AS h FROM x GROUP BY query_id)
          SELECT query_id, CAST(r AS INTEGER) AS n_retrieved, CAST(k AS INTEGER) AS n_shown, CAST(coalesce(len(h), 0) AS INTEGER) AS n_hidden, coalesce(array_to_string(h, ','), '') AS hidden FROM y""",
        "event_counters": "SELECT event_type, CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS half, CAST(coalesce(sum(CAST(ceil(abs(value)) AS BIGINT)), 0) AS BIGINT) AS total FROM events GROUP BY ALL",
        "scan_retrieved": f"""WITH c AS (SELECT DISTINCT object_ref, chunk_id, text, {guarding._case(guard.BUILTIN_INJECTION)} AS rule FROM chunks WHERE object_ref IS NOT NULL)
          SELECT object_ref, count(rule) AS n_flagged, coalesce(array_to_string(list_sort(list(DISTINCT chunk_id) FILTER (rule IS NOT NULL)), ','), '') AS flagged, arg_min(rule, chunk_id) FILTER (rule IS NOT NULL) AS first_rule,
          CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS chars FROM c GROUP BY object_ref""",
        "greedy_fill": """WITH RECURSIVE c AS (SELECT object_ref, row_id, greatest(1, length(text) // 4) AS n, row_number() OVER (PARTITION BY object_ref ORDER BY row_id) AS i FROM chunks WHERE object_ref IS NOT NULL AND text IS NOT NULL),
          f AS (SELECT object_ref, i, CASE WHEN n <= 120 THEN n ELSE 0 END AS used, CASE WHEN n <= 120 THEN CAST(row_id AS VARCHAR) ELSE '' END AS kept FROM c WHERE i = 1
            UNION ALL SELECT c.object_ref, c.i, CASE WHEN used + n <= 120 THEN used + n ELSE used END, CASE WHEN used + n <= 120 THEN kept || CASE WHEN kept = '' THEN '' ELSE ',' END || row_id ELSE kept END FROM f JOIN c ON c.object_ref = f.object_ref AND c.i = f.i + 1)
          SELECT object_ref, CAST(arg_max(used, i) AS BIGINT) AS tokens, arg_max(kept, i) AS kept FROM f GROUP BY object_ref""",
        "dropped_citations": """WITH c AS (SELECT DISTINCT object_ref, CASE WHEN row_id % 3 = 0 THEN chunk_id || '?' ELSE chunk_id END AS cited FROM chunks WHERE object_ref IS NOT NULL), k AS (SELECT DISTINCT object_ref, chunk_id FROM chunks WHERE object_ref IS NOT NULL)
          SELECT c.object_ref, CAST(count(*) FILTER (k.chunk_id IS NULL) AS INTEGER) AS dropped, count(k.chunk_id) > 0 AS grounded FROM c LEFT JOIN k ON k.object_ref = c.object_ref AND k.chunk_id = cited GROUP BY c.object_ref""",
        "usd_estimates": f"""WITH r AS ({g['budget_rungs']}), c AS ({chars}) SELECT object_ref, round((ceil(chars / 4) + {tm.EXPECTED_OUTPUT_TOKENS}) / 1000 * CASE rung WHEN 'full' THEN {PRICES['full']} WHEN 'extractive' THEN {PRICES['extractive']} END, 9)::DOUBLE AS usd FROM r JOIN c USING (object_ref)""",
        "embedding_stats": """WITH c AS (SELECT row_id, text FROM chunks WHERE text IS NOT NULL), k AS (SELECT DISTINCT text FROM c WHERE row_id % 2 = 0)
          SELECT count(*) AS texts, count(*) AS embedded, count(DISTINCT text) FILTER (text NOT IN (SELECT text FROM k)) AS computed, count(DISTINCT text) FILTER (text IN (SELECT text FROM k)) AS cached, count(*) - count(DISTINCT text) AS deduplicated FROM c""",
        "grounded_claims": f"""WITH claims AS (SELECT item_id, passage, unnest(range(len(l))) AS n, unnest(l) AS claim FROM (SELECT item_id, passage, regexp_split_to_array(coalesce(answer, ''), '[.!?] ') AS l FROM eval_items)), {claims}
          SELECT item_id, count(*) AS n_claims, count(*) FILTER (x >= {tm.MIN_SUPPORT}) AS n_kept, CASE WHEN count(*) FILTER (x >= {tm.MIN_SUPPORT}) > 0 THEN 'answered' ELSE 'ungrounded' END AS verdict FROM r GROUP BY item_id""",
        "run_metrics": f"WITH {every} SELECT metric, value FROM m",
        "drift_gates": f"""WITH {every}, {half}, j AS (SELECT m.metric, m.value, h.value AS committed, prefix, tolerance, row_number() OVER (PARTITION BY m.metric ORDER BY length(prefix) DESC) AS k FROM m JOIN h USING (metric) JOIN (VALUES {gates}) g(prefix, tolerance) ON starts_with(m.metric, prefix))
          SELECT metric, prefix AS gate, round(abs(value - committed) / greatest(committed, 1), 9) AS drift, abs(value - committed) / greatest(committed, 1) > tolerance AS breached FROM j WHERE k = 1""",
    }


SQL = _sql()
