"""The chunk index: documents become stamped, embedded chunks, upserted with a checkpoint.

The index is a bucketed table of runs in the shared folder. An upsert appends a run; reading
collapses the rows of a chunk to the last one written, at the place of the first, bucket by
bucket and without a shuffle. Vectors are cached by the digest of their text, and documents
that went in are marked, each in a bucketed table of its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrock.operators import ingest
from quillrock.session import append_bucketed, persisted, scratch_path

CHUNK_COLUMNS = ("row_id", "chunk_id", "object_ref", "object_id", "text", "grant_tokens", "metadata", "embedding")


class EmptyTokens(Exception):
    """A document that nobody may see cannot be indexed."""


class _Table:
    """Appended runs, bucketed by one key."""

    def __init__(self, spark: SparkSession, label: str, schema: str, key: str, buckets: int):
        self.spark, self.schema, self.key, self.buckets = spark, schema, key, buckets
        self.name, self.path, self.runs = f"{label}_{uuid.uuid4().hex}", scratch_path(spark, label), 0

    def append(self, df: DataFrame) -> None:
        placed = df.withColumn("run", F.lit(self.runs)).repartition(self.buckets, self.key)
        append_bucketed(placed, self.name, self.path, [self.key], self.buckets, not self.runs)
        self.runs += 1

    def rows(self) -> DataFrame:
        if not self.runs:
            return self.spark.createDataFrame([], f"{self.schema}, run int")
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)


class ChunkIndex:
    def __init__(self, spark: SparkSession, dim: int = 64, buckets: int | None = None):
        self.spark, self.dim = spark, dim
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        kinds = "row_id bigint, chunk_id string, object_ref string, object_id string, text string, grant_tokens array<string>, metadata map<string,string>, embedding array<float>"
        self._chunks = _Table(spark, "chunks", f"{kinds}, dead boolean", "chunk_id", n)
        self._done = _Table(spark, "checkpoint", "object_ref string", "object_ref", n)
        self._cache = _Table(spark, "vectors", "key string, embedding array<float>", "key", n)

    def chunks(self) -> DataFrame:
        """The live chunks: of each the last row written, at the first one's place."""
        last = F.max_by(F.struct(*CHUNK_COLUMNS[1:], "dead"), "run").alias("v")
        rows = self._chunks.rows().groupBy("chunk_id").agg(F.min("row_id").alias("row_id"), last)
        return rows.where("not v.dead").select("row_id", *[F.col(f"v.{c}").alias(c) for c in CHUNK_COLUMNS[1:]])

    def done(self) -> DataFrame:
        return self._done.rows().select("object_ref").distinct()

    def mark(self, refs: DataFrame) -> None:
        self._done.append(refs.select("object_ref").where("object_ref is not null").distinct())

    def vectors(self) -> DataFrame:
        return self._cache.rows().groupBy("key").agg(F.max_by("embedding", "run").alias("embedding"))

    def compact(self) -> None:
        """Write each table anew as one run."""
        for t, rows in ((self._chunks, self.chunks().withColumn("dead", F.lit(False))), (self._done, self.done()), (self._cache, self.vectors())):
            if t.runs > 1:
                fresh = _Table(self.spark, t.name.rsplit("_", 1)[0], t.schema, t.key, t.buckets)
                fresh.append(rows)
                self.spark.sql(f"DROP TABLE IF EXISTS `{t.name}`")
                t.name, t.path, t.runs = fresh.name, fresh.path, 1

    def upsert(self, chunks: DataFrame) -> None:
        """Insert or replace by ``chunk_id``. Raises where a vector has the wrong length or tokens are
        empty; nothing is written then."""
        bad = chunks.agg(F.count_if((F.size("embedding") != self.dim) | F.col("embedding").isNull()), F.count_if(F.coalesce(F.size("grant_tokens"), F.lit(0)) <= 0)).first()
        if bad[0]:
            raise ValueError(f"{bad[0]} vectors are not of length {self.dim}")
        if bad[1]:
            raise EmptyTokens(f"{bad[1]} chunks")
        self._chunks.append(chunks.select(*CHUNK_COLUMNS, F.lit(False).alias("dead")))

    def _embedded(self, chunks: DataFrame) -> tuple[DataFrame, dict[str, int]]:
        """The chunks with their vectors; equal texts are embedded once, known ones not again."""
        key = ingest.text_key(F.col("text"), self.dim)
        keyed = persisted(chunks.withColumn("key", key), "keyed")
        fresh = persisted(ingest.embedded(keyed, self.vectors(), self.dim), "fresh")
        n = keyed.agg(F.count("*"), F.count_distinct("key")).first()
        computed = fresh.count()
        if computed:
            self._cache.append(fresh)
        counts = {"texts": n[0], "computed": computed, "cached": n[1] - computed, "deduplicated": n[0] - n[1]}
        return keyed.join(self.vectors(), "key").drop("key"), counts

    def _put(self, docs: DataFrame, stamped: DataFrame, cfg: ingest.Chunking) -> dict[str, int]:
        chunks = ingest.chunked(docs, cfg).join(stamped.select(F.col("object").alias("object_ref"), "grant_tokens"), "object_ref")
        meta = F.create_map(*[x for c in ("ordinal", "n_tokens", "char_start", "char_end") for x in (F.lit(c), F.col(c).cast("string"))], F.lit("tokenizer"), F.lit(ingest.TOKENIZER), F.lit("chunking"), F.lit(cfg.fingerprint))
        rows = chunks.select("chunk_id", "object_ref", F.substring_index("object_ref", ":", -1).alias("object_id"), "text", "grant_tokens", meta.alias("metadata"))
        rows, counts = self._embedded(rows)
        place = F.lit(self._chunks.runs << 48) + F.monotonically_increasing_id()
        rows = persisted(rows.withColumn("row_id", place), "embedded")
        self.upsert(rows)
        return counts | {"chunks": rows.count()}

    def run(self, docs: DataFrame, stamped: DataFrame, cfg: ingest.Chunking = ingest.Chunking()) -> dict[str, int]:
        """Take in documents ``object_ref, text`` with their tokens ``object, grant_tokens``.

        A document counts under the first that applies: marked before (skipped), blank (empty),
        without tokens (rejected), indexed. Only indexed ones are marked, after their chunks are
        written, so a run that fails is repeated in full and a repeated run changes nothing.
        Rows of one reference are one document each.
        """
        d = docs.select("object_ref", "text").join(self.done().withColumn("done", F.lit(True)), "object_ref", "left")
        d = d.join(stamped.select(F.col("object").alias("object_ref"), (F.size("grant_tokens") > 0).alias("granted")).distinct(), "object_ref", "left")
        some = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")) != "", F.lit(False))
        kind = F.when(F.coalesce("done", F.lit(False)), "skipped").when(~some, "empty").when(~F.coalesce("granted", F.lit(False)), "rejected").otherwise("indexed")
        d = persisted(d.select("object_ref", "text", kind.alias("kind")), "documents")
        found = {r["kind"]: r["n"] for r in d.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        counts = {k: found.get(k, 0) for k in ("skipped", "empty", "rejected", "indexed")} | {"seen": sum(found.values())}
        taken = d.where("kind = 'indexed'")
        if not counts["indexed"]:
            return counts | dict.fromkeys(("texts", "computed", "cached", "deduplicated", "chunks"), 0)
        counts |= self._put(taken, stamped, cfg)
        self.mark(taken)
        return counts

    def reindex(self, object_ref: str, text: str, tokens: list[str], cfg: ingest.Chunking = ingest.Chunking()) -> int:
        """One document anew: its chunks replace those that stand, older ones go. Returns their number."""
        if not tokens:
            raise EmptyTokens(object_ref)
        docs = self.spark.createDataFrame([(object_ref, text)], "object_ref string, text string")
        stamped = self.spark.createDataFrame([(object_ref, tokens)], "object string, grant_tokens array<string>")
        old = persisted(self.chunks().where(F.col("object_ref") == object_ref), "old")
        n = self._put(docs, stamped, cfg)["chunks"]
        fresh = self._chunks.rows().where(F.col("run") == self._chunks.runs - 1).select("chunk_id")
        stale = old.join(fresh, "chunk_id", "left_anti")
        if not stale.isEmpty():
            self._chunks.append(persisted(stale.select(*CHUNK_COLUMNS, F.lit(True).alias("dead")), "stale"))
        return n

    def restamp(self, stamped: DataFrame) -> int:
        """Give the live chunks of the objects (``object, grant_tokens``) new tokens; those whose object has
        none any more go. Vectors and texts stay as they are. Returns how many chunks moved."""
        fresh = stamped.select(F.col("object").alias("object_ref"), F.col("grant_tokens").alias("__now")).dropDuplicates(["object_ref"])
        moved = self.chunks().join(fresh, "object_ref").where(~F.array_sort("grant_tokens").eqNullSafe(F.array_sort("__now")))
        moved = moved.withColumn("dead", F.coalesce(F.size("__now"), F.lit(0)) <= 0).withColumn("grant_tokens", F.col("__now"))
        moved = persisted(moved.select(*CHUNK_COLUMNS, "dead"), "restamped")
        n = moved.count()
        if n:
            self._chunks.append(moved)
        return n
