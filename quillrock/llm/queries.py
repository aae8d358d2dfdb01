"""Queries of the training-data operators by name, and SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrock.session import table

#: Folder of the public tokenizers' vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: In how many parts, by batch, the deliveries are fed to the pair table.
FEED = 3


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillrock.llm.personal import personal_spans

    spans = personal_spans(table(spark, sf, "messages"), table(spark, sf, "roster"))
    return spans.where(F.col("kind").isin("email", "phone", "id_number", "street_address", "person")).select("row_id", "kind", "char_start")


def p1_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """The bodies with placeholders, as their digests, and how many placeholders each has."""
    from quillrock.llm.personal import redacted

    r = redacted(table(spark, sf, "messages"), table(spark, sf, "roster"))
    marks = F.regexp_count("redacted", F.lit(r"\[(?:EMAIL|PHONE|ID_NUMBER|STREET_ADDRESS|PERSON|CARD_NUMBER|BANK_ACCOUNT)\]"))
    return r.select("row_id", F.md5("redacted").alias("redacted_md5"), F.coalesce(marks, F.lit(0)).alias("n_placeholders"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillrock.llm.pairs import PairTable, message_baskets

    messages = table(spark, sf, "messages").select("row_id", "message_id", "to", "cc", "batch_id")
    counts = PairTable(spark, min_count=4)
    for k in range(FEED):  # as a feed would bring them: a better copy may come in a later part
        counts.upsert(message_baskets(messages.where(F.pmod(F.coalesce("batch_id", F.lit(0)), F.lit(FEED)) == k)))
    return counts.scores(3.0).select(F.col("item_a").alias("addr_a"), F.col("item_b").alias("addr_b"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillrock.llm.neighbours import nearest_vectors, neighbour_pairs

    pairs = neighbour_pairs(nearest_vectors(table(spark, sf, "chunks")))
    return pairs.select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillrock.llm.nearduplicates import similar_messages

    return similar_messages(table(spark, sf, "messages"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillrock.llm.newtext import new_text_lines

    return new_text_lines(table(spark, sf, "messages"), table(spark, sf, "roster"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    from quillrock.llm.tokens import BYTE_BPE_PATTERN, encode_corpus

    return encode_corpus(table(spark, sf, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BYTE_BPE_PATTERN)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillrock.llm.leakage import leaked_items

    return leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    from quillrock.llm.spans import shared_characters

    return shared_characters(table(spark, sf, "documents"))


QUERIES = {"p1_found": p1_found, "p1_redacted": p1_redacted, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_found": p7_found, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found}
_CLEAN = """lower(regexp_replace(regexp_replace(CASE WHEN regexp_extract(x, '<([^<>]*@[^<>]*)>', 1) <> '' THEN regexp_extract(x, '<([^<>]*@[^<>]*)>', 1) ELSE x END, '[<>"''\\s\\p{Z}]+', '', 'g'), '\\.{2,}', '.', 'g'))"""
SQL: dict[str, str] = {
    "p4_found": f"""
WITH entries AS (
  SELECT row_id, nullif(lower(regexp_replace(message_id, '[<>\\s\\p{{Z}}]+', '', 'g')), '') AS cid,
         unnest(list_concat(coalesce("to", []), coalesce(cc, []), ['nobody'])) AS x FROM messages
), clean AS (SELECT DISTINCT row_id, cid, CASE WHEN x LIKE '%@%' THEN {_CLEAN} END AS addr FROM entries),
counted AS (SELECT row_id, cid, count(addr) AS n FROM clean GROUP BY 1, 2),
kept AS (
  SELECT row_id FROM counted WHERE cid IS NULL
  UNION ALL SELECT row_id FROM (SELECT row_id, row_number() OVER (PARTITION BY cid ORDER BY n DESC, row_id) AS k FROM counted WHERE cid IS NOT NULL) WHERE k = 1
), item AS (SELECT row_id, addr FROM clean WHERE addr IS NOT NULL AND row_id IN (SELECT row_id FROM kept)),
total AS (SELECT count(DISTINCT row_id) AS n FROM item),
one AS (SELECT addr, count(*) AS n FROM item GROUP BY 1),
two AS (SELECT a.addr AS a, b.addr AS b, count(*) AS n FROM item a JOIN item b ON a.row_id = b.row_id AND a.addr < b.addr GROUP BY 1, 2 HAVING count(*) >= 4)
SELECT two.a AS addr_a, two.b AS addr_b FROM two JOIN one x ON x.addr = two.a JOIN one y ON y.addr = two.b, total
WHERE two.n * total.n >= 3 * x.n * y.n
""",
    # runs of three words of the kept text of every identifier; equal sets come with the others
    "p6_found": """
WITH rows_ AS (
  SELECT row_id, nullif(lower(regexp_replace(message_id, '[<>\\s\\p{Z}]+', '', 'g')), '') AS cid, regexp_extract_all(lower(coalesce(subject, '') || chr(10) || body), '[\\p{L}\\p{N}]+') AS w
  FROM messages WHERE body IS NOT NULL AND body <> ''
), one AS (SELECT cid, arg_min(w, row_id) AS w FROM rows_ WHERE cid IS NOT NULL GROUP BY cid),
texts AS (SELECT row_number() OVER (ORDER BY min(cid)) AS t, list(cid) AS cids, w FROM one WHERE len(w) >= 3 GROUP BY w),
grams AS (SELECT DISTINCT t, hash(unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)])) AS g FROM texts),
size AS (SELECT t, count(*) AS n FROM grams GROUP BY t),
shared AS (SELECT a.t AS x, b.t AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.t < b.t GROUP BY 1, 2),
near AS (SELECT x, y FROM shared JOIN size p ON p.t = x JOIN size q ON q.t = y WHERE shared.n >= 0.6 * (p.n + q.n - shared.n)),
ids AS (SELECT t, unnest(cids) AS cid FROM texts),
pairs AS (SELECT a.cid AS a, b.cid AS b FROM near JOIN ids a ON a.t = x JOIN ids b ON b.t = y UNION ALL SELECT a.cid, b.cid FROM ids a JOIN ids b ON a.t = b.t AND a.cid < b.cid)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM pairs
""",
    "p9_found": """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(passage), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE passage IS NOT NULL),
g AS (SELECT DISTINCT item_id, unnest([array_to_string(w[k : k + 9], ' ') for k in range(1, len(w) - 8)]) AS g FROM i WHERE len(w) >= 10),
h AS (SELECT doc_id, unnest([array_to_string(w[k : k + 9], ' ') for k in range(1, len(w) - 8)]) AS g FROM d WHERE len(w) >= 10)
SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)
""",
    "p10_found": """
WITH w AS (SELECT doc_id, k, hash(substr(text, k, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS k FROM documents WHERE length(text) >= 300)),
two AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)),
s AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS last FROM w WHERE h IN (SELECT h FROM two))
SELECT doc_id, CAST(sum(CASE WHEN last IS NULL THEN 300 ELSE least(300, k - last) END) AS BIGINT) AS shared_chars FROM s GROUP BY doc_id
""",
    # exact neighbours; the operator is approximate where leaves are many
    "p5_found": """
WITH v AS (SELECT row_id, embedding::DOUBLE[64] AS x FROM chunks WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda e: isfinite(e))) AND list_bool_or(list_transform(embedding, lambda e: e <> 0))),
s AS (SELECT a.row_id AS a, b.row_id AS b, row_number() OVER (PARTITION BY a.row_id ORDER BY round(array_cosine_similarity(a.x, b.x), 6) DESC, b.row_id) AS k FROM v a JOIN v b ON a.row_id <> b.row_id)
SELECT DISTINCT least(a, b) AS row_id_a, greatest(a, b) AS row_id_b FROM s WHERE k <= 5
""",
}
