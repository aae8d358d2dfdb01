"""Queries on mail and documents: merged copies, derived access, chunks, features, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrock.operators import graph, ingest, mail
from quillrock.plans import compiler
from quillrock.session import persisted, table

DOMAIN = "enronix.example"


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "messages")


def dedupe_merge(spark: SparkSession, sf: str) -> DataFrame:
    m = mail.merged_messages(_messages(spark, sf))
    return m.select("row_id", "kept_row_id", "n_copies", F.array_join("mailboxes", ",").alias("mailboxes"), F.array_join("source_paths", ",").alias("source_paths"))


#: A principal that shares its slug ends in a digest, which SQL cannot compute: shown as ``~``.
_DIGEST = "-[0-9a-f]{6}$"


def recipient_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = mail.recipient_sets(mail.merged_messages(_messages(spark, sf)), DOMAIN)
    shown = F.array_sort(F.transform("people", lambda p: F.regexp_replace(p, _DIGEST, "~")))
    return g.select(F.array_join(shown, ",").alias("people"), "support")


def derived_tuples(spark: SparkSession, sf: str) -> DataFrame:
    return mail.derived_tuples(mail.merged_messages(_messages(spark, sf)), DOMAIN)


def derived_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Grants by kind: to lists, to recurring sets, to persons."""
    d = mail.Derivation(mail.merged_messages(_messages(spark, sf)), DOMAIN)
    return d.viewers().groupBy("kind").agg(F.count("*").alias("n_grants"), F.count_distinct("row_id").alias("n_messages"), F.count_distinct("principal").alias("n_principals"))


def derivation_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = mail.Derivation(mail.merged_messages(_messages(spark, sf)), DOMAIN).stats()
    return stats.select("messages", "documents", "skipped", "groups", "groups_from_lists", "groups_from_sets", "grants_via_group", "grants_direct", "principals")


def address_principals(spark: SparkSession, sf: str) -> DataFrame:
    return mail.address_principals(mail.merged_messages(_messages(spark, sf)), DOMAIN).select("address", "n", "is_list", "base", "nth")


def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    return _messages(spark, sf).select("row_id", F.md5(mail.document_text()).alias("text_md5"), F.substring(F.coalesce("subject", F.lit("")), 1, mail.SUBJECT_CHARS).alias("title"))


def mail_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Where no chunk of a mail may run across, and what stands beside its text."""
    d = mail.mail_documents(_messages(spark, sf))
    return d.select("row_id", F.array_join("boundaries", ",").alias("boundaries"), F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("metadata"), F.md5("text").alias("text_md5"))


def mail_objects(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose object is the digest of an identifier in the mail, and chunks of other objects."""
    named = _messages(spark, sf).select(mail.message_object(F.col("message_id"), F.col("row_id")).alias("ref")).distinct().withColumn("mail", F.lit(True))
    c = table(spark, sf, "chunks").select(F.concat(F.lit("doc:"), "object_id").alias("ref"))
    return c.join(named, "ref", "left").agg(F.count_if("mail").alias("n_mail"), F.count("*").alias("n"))


def chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(F.coalesce("object_ref", F.concat(F.lit("doc:"), F.col("doc_id"))).alias("object_ref"), "text")
    return ingest.chunked(d).select("chunk_id", "object_ref", "ordinal", "char_start", "char_end", "n_tokens", F.md5("text").alias("text_md5"))


def hash_features(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.hashed_features(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def hash_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Unit-length BLAKE2b embeddings of the distinct chunk texts."""
    e = ingest.embedded(table(spark, sf, "chunks").select("text"))
    where = F.array_join(F.transform(F.filter(F.transform("embedding", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"] != 0), lambda s: F.concat(s["i"].cast("string"), F.when(s["x"] > 0, "+").otherwise("-"))), " ")
    return e.select("key", F.md5(where).alias("signs_md5"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")), 4).alias("norm2"), F.size("embedding").alias("dim"))


def embed_dedup_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.embedding_counters(table(spark, sf, "chunks"))


def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that stand in the index already count as done."""
    t = graph.oriented(table(spark, sf, "tuples"))
    docs = table(spark, sf, "documents").select("object_ref", "text")
    refs = docs.select(F.col("object_ref").alias("object")).where("object is not null").distinct()
    done = table(spark, sf, "chunks").where("object_ref is not null").select("object_ref")
    return ingest.ingest_report(docs, compiler.stamp_tokens(refs, t), done)


def ingest_run(spark: SparkSession, sf: str) -> DataFrame:
    """The whole pipeline over the mail: merged copies, access derived and applied as one epoch, documents
    chunked, embedded, stamped, upserted and marked; first those of even rows, then all, where the
    first are found done. What is left in the index is counted from its rows."""
    from quillrock.operators.index import ChunkIndex
    from quillrock.operators.policystore import PolicyStore

    merged = persisted(mail.merged_messages(_messages(spark, sf)), "merged")
    store = PolicyStore(spark)
    epoch, _ = store.apply(persisted(mail.derived_tuples(merged, DOMAIN), "derived"))
    docs = persisted(mail.mail_documents(merged).select("row_id", "object_ref", "text"), "maildocs")
    stamped = persisted(compiler.stamp_tokens(docs.select(F.col("object_ref").alias("object")).distinct(), store.tuples()), "stamped")
    index = ChunkIndex(spark)
    first = index.run(docs.where("row_id % 2 = 0"), stamped)
    second = index.run(docs, stamped)
    held = index.chunks().agg(F.count_distinct("object_ref").alias("n_objects"), F.count_if(F.size("grant_tokens") == 0).alias("n_open"), (F.count("*") == first["chunks"] + second["chunks"]).alias("all_held"))
    names = ("seen", "skipped", "empty", "rejected", "indexed")
    return held.select(F.lit(epoch).cast("bigint").alias("epoch"), *[F.lit(second[n]).cast("bigint").alias(n) for n in names], F.lit(first["indexed"]).cast("bigint").alias("indexed_first"), "n_objects", "n_open", "all_held")


def question_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out questions and answers, zipped from lists that also hold an empty question and one without
    an answer."""
    e = table(spark, sf, "eval_items").select("item_id", F.array("question", F.lit(" "), "passage").alias("questions"), F.array("answer", F.lit("x")).alias("answers"))
    return mail.questions(e)


def upsert_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks indexed twice: the last row's values at the first row's position."""
    from quillrock.operators.search import upserted

    c = table(spark, sf, "chunks").select("row_id", "chunk_id", "object_ref", "text")
    return upserted(c, c.limit(0)).select("row_id", "chunk_id", "object_ref", F.md5("text").alias("text_md5"))


def index_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "chunks")
    tokens = c.select(F.explode("grant_tokens").alias("t")).agg(F.count_distinct("t").alias("n_tokens"))
    own = c.agg(
        F.count("*").alias("n_rows"), F.count_distinct("chunk_id").alias("n_chunks"), F.count_distinct("object_ref").alias("n_objects"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("text_bytes"),
    )
    return own.crossJoin(tokens)  # one row each


QUERIES = {
    f.__name__: f
    for f in (
        dedupe_merge, recipient_groups, derived_tuples, derived_counts, derivation_stats, address_principals, document_texts, mail_documents, mail_objects, chunk_texts, hash_features, hash_embeddings,
        embed_dedup_counts, ingest_report, ingest_run, question_rows, upsert_last_wins, index_stats,
    )
}

_CLEAN = r"""lower(regexp_replace(regexp_replace(CASE WHEN regexp_matches(x, '<[^<>]*@[^<>]*>') THEN regexp_extract(x, '<([^<>]*@[^<>]*)>', 1) ELSE x END,
  '[<>"''\s\p{Z}]+', '', 'g'), '[.]{2,}', '.', 'g'))"""
_ADDR = f"""list_distinct(list_filter(list_transform(list_concat(coalesce("to", []), coalesce(cc, [])), lambda x: {_CLEAN}), lambda x: contains(x, '@')))"""
_CID = r"nullif(lower(regexp_replace(message_id, '[<>\s\p{Z}]+', '', 'g')), '')"
_SLUG = lambda c: f"regexp_replace(regexp_replace(lower(trim({c})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_INSIDE = "(split_part(a, '@', -1) = 'enronix.example' OR split_part(a, '@', -1) LIKE '%.enronix.example')"
_DL = f"({_INSIDE} AND regexp_matches(split_part(a, '@', 1), '{mail.LIST_PATTERN}', 'i'))"
_MERGED = f"""m0 AS (SELECT *, coalesce({_CID}, '#' || row_id) AS k, len({_ADDR}) AS n FROM messages),
best AS (SELECT k, min(row_id) AS row_id, count(*) AS n_copies, arg_max(row_id, (n, -row_id)) AS kept FROM m0 GROUP BY k)"""
_PEOPLE = f"""{_MERGED},
kept AS (SELECT best.row_id, k, sender AS x, "to", cc FROM best JOIN messages ON messages.row_id = kept),
said AS (SELECT row_id, 0 AS pos, {_CLEAN} AS a FROM kept UNION ALL SELECT row_id, generate_subscripts(l, 1), unnest(l) FROM (SELECT row_id, {_ADDR} AS l FROM kept)),
mentions AS (SELECT * FROM said WHERE contains(a, '@')),
seen AS (SELECT a, count(*) AS n, min(row_id * 100000 + pos) AS first, {_DL} AS is_list,
  CASE WHEN {_INSIDE} THEN {_SLUG("split_part(a, '@', 1)")} ELSE {_SLUG("replace(a, '@', '-at-')")} END AS base FROM mentions GROUP BY a),
principals AS (SELECT *, row_number() OVER (PARTITION BY is_list, CASE WHEN base = '' THEN a ELSE base END ORDER BY first) AS nth FROM seen),
named AS (SELECT DISTINCT row_id, pos > 0 AS to_, is_list, CASE WHEN is_list THEN 'group:dl_' || base || '#member' WHEN nth > 1 OR base = '' THEN 'user:' || base || '~' || a ELSE 'user:' || base END AS p,
  CASE WHEN nth > 1 THEN 'user:' || base || '~' ELSE 'user:' || regexp_replace(base, '-[0-9a-f]{{6}}$', '~') END AS shown FROM mentions JOIN principals USING (a)),
owners AS (SELECT DISTINCT row_id, 'user:' || s AS p, 'user:' || regexp_replace(s, '-[0-9a-f]{{6}}$', '~') AS shown FROM
  (SELECT best.row_id, {_SLUG("m")} AS s FROM (SELECT k, unnest(mailboxes) AS m FROM m0) JOIN best USING (k)) WHERE s <> ''),
persons AS (SELECT row_id, p, shown FROM owners UNION SELECT row_id, p, shown FROM named WHERE NOT is_list),
people AS (SELECT row_id, list_sort(list(p)) AS people, list_sort(list(shown)) AS shown FROM persons GROUP BY row_id),
sets AS (SELECT people, any_value(shown) AS shown, count(*) AS support FROM people WHERE len(people) >= {mail.MIN_GROUP_SIZE} GROUP BY people HAVING count(*) >= {mail.MIN_GROUP_SUPPORT}),
lists AS (SELECT DISTINCT named.p FROM named JOIN owners o USING (row_id) WHERE is_list AND to_),
viewers AS (SELECT DISTINCT row_id, p, 'list' AS kind FROM named WHERE is_list
  UNION ALL SELECT row_id, array_to_string(people, ' '), 'set' FROM people WHERE people IN (SELECT people FROM sets)
  UNION ALL SELECT row_id, p, 'person' FROM owners WHERE row_id IN (SELECT row_id FROM people WHERE people IN (SELECT people FROM sets))
  UNION ALL SELECT row_id, unnest(people), 'person' FROM people WHERE people NOT IN (SELECT people FROM sets))"""
_UNITS = """w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '([a-z0-9]+)', 1) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS u FROM w UNION ALL SELECT doc_id, unnest([w[i] || '_' || w[i + 1] for i in range(1, len(w))]) FROM w)"""

SQL = {
    "dedupe_merge": f"""WITH {_MERGED},
      mb AS (SELECT k, string_agg(x, ',' ORDER BY r, i) AS s FROM (SELECT k, x, min(row_id) AS r, arg_min(i, (row_id, i)) AS i FROM (SELECT k, row_id, unnest(mailboxes) AS x, generate_subscripts(mailboxes, 1) AS i FROM m0) WHERE x IS NOT NULL GROUP BY k, x) GROUP BY k),
      sp AS (SELECT k, string_agg(x, ',' ORDER BY r, i) AS s FROM (SELECT k, x, min(row_id) AS r, arg_min(i, (row_id, i)) AS i FROM (SELECT k, row_id, unnest(source_paths) AS x, generate_subscripts(source_paths, 1) AS i FROM m0) WHERE x IS NOT NULL GROUP BY k, x) GROUP BY k)
      SELECT row_id, kept AS kept_row_id, n_copies, mb.s AS mailboxes, sp.s AS source_paths FROM best LEFT JOIN mb USING (k) LEFT JOIN sp USING (k)""",
    "recipient_groups": f"WITH {_PEOPLE} SELECT array_to_string(shown, ',') AS people, support FROM sets",
    "address_principals": f"WITH {_PEOPLE} SELECT a AS address, n, is_list, base, nth FROM principals",
    "derived_counts": f"WITH {_PEOPLE} SELECT kind, count(*) AS n_grants, count(DISTINCT row_id) AS n_messages, count(DISTINCT p) AS n_principals FROM viewers GROUP BY kind",
    "derivation_stats": f"""WITH {_PEOPLE} SELECT (SELECT count(*) FROM best) AS messages, (SELECT count(DISTINCT row_id) FROM viewers) AS documents,
      (SELECT count(*) FROM best) - (SELECT count(DISTINCT row_id) FROM viewers) AS skipped, (SELECT count(*) FROM lists) + (SELECT count(*) FROM sets) AS groups,
      (SELECT count(*) FROM lists) AS groups_from_lists, (SELECT count(*) FROM sets) AS groups_from_sets, (SELECT count(*) FROM viewers WHERE kind <> 'person') AS grants_via_group,
      (SELECT count(*) FROM viewers WHERE kind = 'person') AS grants_direct, (SELECT count(DISTINCT p) FROM viewers) AS principals""",
    "document_texts": f"""WITH h AS (SELECT row_id, body, subject, concat_ws(chr(10), CASE WHEN length(subject) > 0 THEN 'Subject: ' || subject END, CASE WHEN length(sender) > 0 THEN 'From: ' || sender END,
      CASE WHEN length(array_to_string("to", ', ')) > 0 THEN 'To: ' || array_to_string("to", ', ') END, CASE WHEN length(array_to_string(cc, ', ')) > 0 THEN 'Cc: ' || array_to_string(cc, ', ') END,
      CASE WHEN length(date) > 0 THEN 'Date: ' || date END) AS head FROM messages)
      SELECT row_id, md5(CASE WHEN head = '' THEN body ELSE head || chr(10) || chr(10) || coalesce(body, '') END) AS text_md5, substr(coalesce(subject, ''), 1, {mail.SUBJECT_CHARS}) AS title FROM h""",
    "mail_documents": f"""WITH h AS (SELECT *, concat_ws(chr(10), CASE WHEN length(subject) > 0 THEN 'Subject: ' || subject END, CASE WHEN length(sender) > 0 THEN 'From: ' || sender END,
      CASE WHEN length(array_to_string("to", ', ')) > 0 THEN 'To: ' || array_to_string("to", ', ') END, CASE WHEN length(array_to_string(cc, ', ')) > 0 THEN 'Cc: ' || array_to_string(cc, ', ') END,
      CASE WHEN length(date) > 0 THEN 'Date: ' || date END) AS head FROM messages), t AS (SELECT *, CASE WHEN head = '' THEN body ELSE head || chr(10) || chr(10) || coalesce(body, '') END AS text FROM h),
      m AS (SELECT row_id, unnest([i for i in range(2, length(text) + 1) if {" OR ".join(f"substr(text, i, {len(q)}) = '" + q.replace(chr(10), "' || chr(10) || '") + "'" for q in mail.QUOTE_MARKERS)}]) - 1 AS o FROM t WHERE text IS NOT NULL
        UNION SELECT row_id, strpos(text, chr(10) || chr(10)) + 1 FROM t WHERE strpos(text, chr(10) || chr(10)) > 1 AND strpos(text, chr(10) || chr(10)) + 1 < length(text)),
      l AS (SELECT row_id, array_to_string(list_sort(list(o)), ',') AS b FROM m GROUP BY row_id)
      SELECT t.row_id, coalesce(b, '') AS boundaries, array_to_string(list_sort(list_filter([CASE WHEN length(message_id) > 0 THEN 'message_id' END, CASE WHEN length(subject) > 0 THEN 'subject' END, CASE WHEN length(sender) > 0 THEN 'sender' END,
        CASE WHEN length(date) > 0 THEN 'date' END], lambda x: x IS NOT NULL)), ',') AS metadata, md5(text) AS text_md5 FROM t LEFT JOIN l ON l.row_id = t.row_id""",
    "hash_features": f"""WITH {_UNITS}, h AS (SELECT doc_id, md5(u) AS h FROM u)
      SELECT doc_id, CAST(('0x' || substr(h, 1, 8))::BIGINT % 64 AS INTEGER) AS idx, CAST(sum(CASE WHEN ('0x' || substr(h, 9, 1))::INT % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS value FROM h GROUP BY 1, 2 HAVING sum(CASE WHEN ('0x' || substr(h, 9, 1))::INT % 2 = 1 THEN 1 ELSE -1 END) <> 0""",
    "embed_dedup_counts": "SELECT count(*) AS texts, count(DISTINCT text) AS computed, count(*) - count(DISTINCT text) AS deduplicated FROM chunks WHERE text IS NOT NULL",
    "question_rows": """SELECT item_id, CAST(0 AS INTEGER) AS n, question, coalesce(answer, '') AS answer FROM eval_items WHERE trim(question) <> ''
      UNION ALL SELECT item_id, CAST(2 AS INTEGER), passage, '' FROM eval_items WHERE trim(passage) <> ''""",
    "upsert_last_wins": "SELECT min(row_id) AS row_id, chunk_id, arg_max(struct_pack(o := object_ref), row_id).o AS object_ref, md5(arg_max(struct_pack(t := text), row_id).t) AS text_md5 FROM chunks GROUP BY chunk_id",
    "index_stats": "SELECT count(*) AS n_rows, count(DISTINCT chunk_id) AS n_chunks, count(DISTINCT object_ref) AS n_objects, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS text_bytes, (SELECT count(DISTINCT t) FROM (SELECT unnest(grant_tokens) AS t FROM chunks)) AS n_tokens FROM chunks",
}


def _ingest_sql() -> dict[str, str]:
    from quillrock.queries.permissions import _T, _up

    report = f"""WITH RECURSIVE {_T}, {_up(8)}, g AS (SELECT DISTINCT object FROM leaves), done AS (SELECT DISTINCT object_ref FROM chunks),
      d AS (SELECT coalesce(regexp_matches(text, '\\S'), false) AS some_, g.object IS NOT NULL AS ok, done.object_ref IS NOT NULL AS was FROM documents LEFT JOIN g ON g.object = documents.object_ref LEFT JOIN done ON done.object_ref = documents.object_ref)
      SELECT count(*) AS seen, count(*) FILTER (was) AS skipped, count(*) FILTER (NOT was AND NOT some_) AS empty, count(*) FILTER (NOT was AND some_ AND NOT ok) AS rejected, count(*) FILTER (NOT was AND some_ AND ok) AS indexed FROM d"""
    run = f"""WITH {_PEOPLE}, t AS (SELECT best.row_id, coalesce(regexp_matches(concat_ws(' ', subject, sender, array_to_string("to", ''), array_to_string(cc, ''), date, body), '\\S'), false) AS some_ FROM best JOIN messages ON messages.row_id = kept),
      d AS (SELECT row_id, some_, row_id IN (SELECT row_id FROM viewers) AS ok, row_id % 2 = 0 AS first FROM t)
      SELECT CAST(1 AS BIGINT) AS epoch, count(*) AS seen, count(*) FILTER (first AND some_ AND ok) AS skipped, count(*) FILTER (NOT some_) AS empty, count(*) FILTER (some_ AND NOT ok) AS rejected,
      count(*) FILTER (NOT first AND some_ AND ok) AS indexed, count(*) FILTER (first AND some_ AND ok) AS indexed_first, count(*) FILTER (some_ AND ok) AS n_objects, CAST(0 AS BIGINT) AS n_open, true AS all_held FROM d"""
    return {"ingest_report": report, "ingest_run": run}


SQL |= _ingest_sql()
