"""Queries on text rules, claims, budgets and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrock.functions import guard
from quillrock.functions import textmetrics as tm
from quillrock.operators import audit
from quillrock.session import table


def injection_builtin(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").groupBy(guard.injection_name(F.col("text")).alias("rule")).agg(F.count("*").alias("n"))


def injection_rules(spark: SparkSession, sf: str) -> DataFrame:
    s = guard.scanned(table(spark, sf, "documents"), "doc_id").where("scan = 'injection'")
    return s.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_docs"), F.max("severity").alias("severity"))


def pii_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = guard.scanned(table(spark, sf, "documents"), "doc_id").where("scan = 'sensitive'")
    return s.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_docs"))


def redacted_documents(spark: SparkSession, sf: str) -> DataFrame:
    r = guard.redacted_texts(table(spark, sf, "documents"), "doc_id", guard.INGEST_KINDS)
    return r.select("id", F.md5("redacted").alias("redacted_md5"), F.coalesce(F.regexp_count("redacted", F.lit(r"\[[A-Z_]+:[0-9a-f]{6}\]")), F.lit(0)).alias("n_marks"))


def audit_redaction(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "messages").select("row_id", "body", guard.audit_redacted(F.col("body")).alias("r"))
    return d.where("body <> r").select("row_id", F.size(F.split("r", r"\[REDACTED:")).alias("parts"))


def number_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Luhn, mod 97 and octet checks over numbers made of every order and customer key."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("k"))
    padded = F.lpad("k", 16, "4")
    iban = F.concat(F.lit("GB"), F.lpad((F.col("k").cast("bigint") % 97).cast("string"), 2, "0"), F.lit("WEST"), F.lpad("k", 14, "0"))
    ip = F.concat_ws(".", (F.col("k").cast("bigint") % 300).cast("string"), F.lit("10"), F.lit("0"), F.substring("k", -1, 1))
    return o.agg(
        F.count_if(tm.luhn_valid(padded)).alias("luhn"), F.count_if(tm.iban_valid(iban)).alias("iban"), F.count_if(tm.ip_valid(ip)).alias("ip"), F.count("*").alias("n")
    )


def support_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each held-out question, and its answer, as claims on the passage."""
    e = table(spark, sf, "eval_items")
    claim = F.concat_ws(" ", "question", "answer")
    return e.select("item_id", F.round(tm.support_score(claim, F.col("passage")), 6).alias("support"), (tm.support_score(claim, F.col("passage")) >= tm.MIN_SUPPORT).alias("grounded"))


def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.groupBy("doc_kind").agg(F.sum(tm.budget_tokens(F.col("text"))).alias("budget"), F.sum(tm.generation_tokens(F.col("text"))).alias("generation"), (F.sum(F.coalesce(F.length("text"), F.lit(0))) + tm.CONTEXT_OVERHEAD * F.count("*")).alias("context"))


def budget_rungs(spark: SparkSession, sf: str) -> DataFrame:
    """The rung of an answer from all chunks of one object."""
    c = table(spark, sf, "chunks").where("object_ref is not null").groupBy("object_ref").agg(F.count("text").alias("n"), (F.sum(F.coalesce(F.length("text"), F.lit(0))) + tm.CONTEXT_OVERHEAD * F.count("text")).alias("chars"))
    return c.select("object_ref", tm.budget_rung(F.col("n"), F.col("chars"), F.lit("what is said here?")).alias("rung"))


def passage_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Extractive prefix: chunks of an object in order until the next would pass the context's limit."""
    from pyspark.sql import Window

    w = Window.partitionBy("object_ref").orderBy("row_id").rowsBetween(Window.unboundedPreceding, 0)
    c = table(spark, sf, "chunks").where("object_ref is not null and text is not null").select("object_ref", "row_id", F.length("text").alias("n"))
    c = c.withColumn("used", F.sum(F.col("n") + tm.CONTEXT_OVERHEAD).over(w)).where(F.col("used") <= tm.MAX_CONTEXT_CHARS)
    return c.groupBy("object_ref").agg(F.count("*").alias("n_shown"), F.max("used").alias("chars"))


def parse_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Replies made of every held-out item, and what is read of them."""
    e = table(spark, sf, "eval_items")
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(F.struct(F.col("answer").alias("text"), F.array(F.concat(F.lit("ch_"), "item_id")).alias("chunk_ids")), F.struct(F.lit(" ").alias("text"), F.array(F.lit("x")).alias("chunk_ids"))).alias("claims"))), F.lit("\n```"))
    c = e.select("item_id", F.explode(tm.parsed_claims(reply)).alias("c"))
    return c.select("item_id", F.col("c.text").alias("claim"), F.array_join("c.chunk_ids", ",").alias("chunk_ids"))


def citations(spark: SparkSession, sf: str) -> DataFrame:
    """Cited ids of each object's claims that are among its chunks, first seen first; unknown ids vanish."""
    c = table(spark, sf, "chunks").where("object_ref is not null").select("object_ref", "chunk_id", "row_id")
    cited = c.select("object_ref", "chunk_id", "row_id").unionByName(c.select("object_ref", F.concat("chunk_id", F.lit("?")).alias("chunk_id"), "row_id"))
    known = c.select("object_ref", "chunk_id").distinct()
    return cited.join(known, ["object_ref", "chunk_id"]).groupBy("object_ref", "chunk_id").agg(F.min("row_id").alias("first_row"), F.count("*").alias("times"))


def query_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "eval_items").select("item_id", tm.query_hash(F.col("question")).alias("hash"))


def _audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    json = audit.canonical_json(event_id=F.col("event_id"), event_type=F.col("event_type"), user_id=F.col("user_id"))
    return e.select(F.col("user_id"), F.to_date("ts").alias("day"), F.col("event_id").alias("id"), json.alias("json"), "ts")


def _streams(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "day").orderBy("id")
    rows = _audit_rows(spark, sf).withColumn("seq", F.row_number().over(w).cast("bigint")).drop("ts", "id")
    return audit.chained(rows, ["user_id", "day"])


def audit_chain(spark: SparkSession, sf: str) -> DataFrame:
    """The head of each user's chain of each day."""
    return _streams(spark, sf).groupBy("user_id", F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.max_by("digest", "seq").alias("head"))


def audit_verify(spark: SparkSession, sf: str) -> DataFrame:
    """Chains of which every third row was changed after the fact: the first that fails."""
    c = _streams(spark, sf)
    bad = c.withColumn("json", F.when(F.col("seq") % 3 == 0, F.concat("json", F.lit(" "))).otherwise(F.col("json")))
    return audit.verified(bad, ["user_id", "day"]).select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "n", "first_bad", "reason")


def audit_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page: the limit is the feature."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), "user_id", "event_type")
    return audit.page(e, 100)


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return audit.histogram(table(spark, sf, "events"), "event_type", F.col("value") / 100).withColumn("sum", F.round("sum", 4))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return audit.nearest_ranks(table(spark, sf, "events"), "event_type", "value", p50=0.5, p95=0.95)


def metrics_lines(spark: SparkSession, sf: str) -> DataFrame:
    return audit.exposition(latency_histogram(spark, sf), "event_type", "latency_seconds", "Latency of events.")


def _cost() -> "F.Column":
    return F.ceil(F.coalesce(F.col("value"), F.lit(0.0))).cast("bigint") * 40


def daily_spend(spark: SparkSession, sf: str) -> DataFrame:
    s = audit.daily_spend(table(spark, sf, "events"), "user_id", "ts", _cost())
    return s.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), "spent", F.greatest(F.lit(0), F.lit(tm.PRINCIPAL_TOKENS_A_DAY) - F.col("spent")).alias("remaining"))


def budget_admission(spark: SparkSession, sf: str) -> DataFrame:
    a = audit.admitted(table(spark, sf, "events"), "user_id", "ts", "event_id", _cost(), 2_000)
    return a.groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"))


QUERIES = {
    f.__name__: f
    for f in (
        injection_builtin, injection_rules, pii_counts, redacted_documents, audit_redaction, number_checks, support_scores, token_estimates, budget_rungs, passage_fill,
        parse_claims, citations, query_hashes, audit_chain, audit_verify, audit_page, latency_histogram, latency_percentiles, metrics_lines, daily_spend, budget_admission,
    )
}


def _case(patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in patterns) + " END"


_TOK = r"list_filter(list_transform(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_£$€%.,/\-]+'), lambda x: regexp_replace(x, '^[.,]+|[.,]+$', '', 'g')), lambda x: x <> '')"
_STOP = ", ".join(f"'{w}'" for w in tm.STOPWORDS)
_NEG = ", ".join(f"'{w}'" for w in tm.NEGATIONS)
_NUM = r"regexp_replace(regexp_replace({}, '[£$€,]', '', 'g'), '[.]+$', '')"
_ISNUM = r"regexp_matches({}, '^[£$€]?[0-9][0-9.,/%\-]*$')"
_CONTENT = f"list_distinct(list_filter({{0}}, lambda x: length(x) > 2 AND x NOT IN ({_STOP})))"
_NUMS = f"list_distinct(list_filter(list_transform(list_filter({{0}}, lambda x: {_ISNUM.format('x')}), lambda x: {_NUM.format('x')}), lambda x: x <> ''))"
_PAIRS = f"list_distinct([{_NUM.format('{0}[i]')} || ' ' || {{0}}[i + 1] for i in range(1, len({{0}})) if {_ISNUM.format('{0}[i]')} AND regexp_matches({{0}}[i + 1], '^\\p{{{{L}}}}{{{{2,}}}}$')])"
_SUPPORT = f"""s AS (SELECT item_id, {_TOK.format("concat_ws(' ', question, answer)")} AS c, {_TOK.format("passage")} AS e FROM eval_items),
v AS (SELECT item_id, {_CONTENT.format("c")} AS cc, {_CONTENT.format("e")} AS ec, {_NUMS.format("c")} AS cn, {_NUMS.format("e")} AS en, {_PAIRS.format("c")} AS cp, {_PAIRS.format("e")} AS ep,
  list_has_any(c, [{_NEG}]) AS nc, list_has_any(e, [{_NEG}]) AS ne FROM s),
r AS (SELECT item_id, CASE WHEN len(cc) = 0 THEN 0.0 WHEN NOT list_has_all(en, cn) OR NOT list_has_all(ep, cp) THEN 0.0
  ELSE len(list_intersect(cc, ec)) / len(cc) * CASE WHEN nc <> ne THEN {tm.NEGATION_FACTOR} ELSE 1 END END::DOUBLE AS x FROM v)"""
_COST = "CAST(ceil(coalesce(value, 0)) AS BIGINT) * 40"
_JSON = """'{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}'"""
_CHAIN = f"""ev AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id) AS seq, {_JSON} AS json FROM events),
ch AS (SELECT user_id, day, seq, json, repeat('0', 64) AS prev, sha256(repeat('0', 64) || chr(10) || json) AS digest FROM ev WHERE seq = 1
  UNION ALL SELECT ev.user_id, ev.day, ev.seq, ev.json, ch.digest, sha256(ch.digest || chr(10) || ev.json) FROM ch JOIN ev ON ev.user_id = ch.user_id AND ev.day = ch.day AND ev.seq = ch.seq + 1)"""
_EDGES = ", ".join(f"({e}, '{e:g}')" for e in audit.LATENCY_EDGES)
_HIST = f"SELECT event_type, l AS le, count(*) FILTER (value / 100 <= e) AS n, round(sum(value / 100), 4) AS sum FROM events, (VALUES {_EDGES}, (1e300, '+Inf')) x(e, l) WHERE value IS NOT NULL GROUP BY ALL"

SQL = {
    "injection_builtin": f"SELECT {_case([x for x in guard.BUILTIN_INJECTION])} AS rule, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "number_checks": """WITH k AS (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders),
      x AS (SELECT lpad(k, 16, '4') AS card, lpad(k, 14, '0') || '1611' || lpad(CAST(CAST(k AS BIGINT) % 97 AS VARCHAR), 2, '0') AS turned, k FROM k)
      SELECT count(*) FILTER (list_sum([CASE WHEN (i % 2) = 1 THEN CASE WHEN 2 * CAST(card[i] AS INT) > 9 THEN 2 * CAST(card[i] AS INT) - 9 ELSE 2 * CAST(card[i] AS INT) END ELSE CAST(card[i] AS INT) END for i in range(1, 17)]) % 10 = 0) AS luhn,
      count(*) FILTER (CAST('32142829' || turned AS HUGEINT) % 97 = 1) AS iban, count(*) FILTER (CAST(k AS BIGINT) % 300 <= 255) AS ip, count(*) AS n FROM x""",
    "support_scores": f"WITH {_SUPPORT} SELECT item_id, round(x, 6) AS support, x >= {tm.MIN_SUPPORT} AS grounded FROM r",
    "token_estimates": "SELECT doc_kind, CAST(sum(CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT)) AS BIGINT) AS budget, CAST(sum(greatest(1, length(coalesce(text, '')) // 4)) AS BIGINT) AS generation, CAST(sum(length(coalesce(text, ''))) + 24 * count(*) AS BIGINT) AS context FROM documents GROUP BY doc_kind",
    "budget_rungs": f"""WITH c AS (SELECT object_ref, count(text) AS n, sum(coalesce(length(text), 0)) + {tm.CONTEXT_OVERHEAD} * count(text) AS chars FROM chunks WHERE object_ref IS NOT NULL GROUP BY object_ref)
      SELECT object_ref, CASE WHEN n = 0 THEN 'refuse' WHEN chars > {tm.MAX_CONTEXT_CHARS} THEN 'extractive' WHEN ceil(18 / 4) + ceil(chars / 4) + {tm.EXPECTED_OUTPUT_TOKENS} > {tm.MAX_REQUEST_TOKENS} THEN 'extractive' ELSE 'full' END AS rung FROM c""",
    "passage_fill": f"""WITH c AS (SELECT object_ref, sum(length(text) + {tm.CONTEXT_OVERHEAD}) OVER (PARTITION BY object_ref ORDER BY row_id) AS used FROM chunks WHERE object_ref IS NOT NULL AND text IS NOT NULL)
      SELECT object_ref, count(*) AS n_shown, CAST(max(used) AS BIGINT) AS chars FROM c WHERE used <= {tm.MAX_CONTEXT_CHARS} GROUP BY object_ref""",
    "parse_claims": "SELECT item_id, answer AS claim, 'ch_' || item_id AS chunk_ids FROM eval_items WHERE trim(answer) <> ''",
    "citations": "SELECT object_ref, chunk_id, min(row_id) AS first_row, count(*) AS times FROM chunks WHERE object_ref IS NOT NULL GROUP BY ALL",
    "query_hashes": r"SELECT item_id, 'u:' || substr(sha256('quillrock/query/v1' || chr(10) || lower(trim(regexp_replace(question, '\s+', ' ', 'g')))), 1, 32) AS hash FROM eval_items",
    "audit_chain": f"WITH RECURSIVE {_CHAIN} SELECT user_id, day, count(*) AS n, arg_max(digest, seq) AS head FROM ch GROUP BY ALL",
    "audit_verify": f"""WITH RECURSIVE {_CHAIN}, bad AS (SELECT *, CASE WHEN seq % 3 = 0 THEN json || ' ' ELSE json END AS now FROM ch),
      v AS (SELECT *, lag(digest) OVER w AS before, lag(seq) OVER w AS last FROM bad WINDOW w AS (PARTITION BY user_id, day ORDER BY seq)),
      r AS (SELECT user_id, day, seq, CASE WHEN last IS NOT NULL AND seq <> last + 1 THEN 'sequence gap' WHEN prev <> coalesce(before, repeat('0', 64)) THEN 'broken link'
        WHEN sha256(prev || chr(10) || now) <> digest THEN 'content changed' END AS reason FROM v)
      SELECT user_id, day, count(*) AS n, min(seq) FILTER (reason IS NOT NULL) AS first_bad, arg_min(reason, seq) FILTER (reason IS NOT NULL) AS reason FROM r GROUP BY ALL""",
    "audit_page": "SELECT event_id AS seq, user_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 500",
    "latency_histogram": _HIST,
    "latency_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "metrics_lines": f"""WITH h AS ({_HIST}) SELECT 'latency_seconds_bucket{{event_type="' || event_type || '",le="' || le || '"}} ' || n AS line FROM h
      UNION ALL SELECT 'latency_seconds_sum{{event_type="' || event_type || '"}} ' || CAST(CAST(sum AS DECIMAL(38, 6)) AS VARCHAR) FROM h WHERE le = '+Inf'
      UNION ALL SELECT 'latency_seconds_count{{event_type="' || event_type || '"}} ' || n FROM h WHERE le = '+Inf'
      UNION ALL VALUES ('# HELP latency_seconds Latency of events.'), ('# TYPE latency_seconds histogram')""",
    "daily_spend": f"SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum({_COST}) AS BIGINT) AS spent, CAST(greatest(0, {tm.PRINCIPAL_TOKENS_A_DAY} - sum({_COST})) AS BIGINT) AS remaining FROM events GROUP BY ALL",
    "budget_admission": f"""WITH a AS (SELECT user_id, {_COST} AS c, coalesce(sum({_COST}) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events)
      SELECT user_id, count(*) FILTER (before + c <= 2000) AS admitted, count(*) FILTER (before + c > 2000) AS refused FROM a GROUP BY user_id""",
}
