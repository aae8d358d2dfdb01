"""Messages delivered more than once: exactly one copy of each stays.

Deliveries are upserted into hash-bucketed storage, sorted by identifier in each bucket. An
upsert first collapses its own batch (a partial aggregate runs before the shuffle, so an
identifier that holds a third of all rows costs one row per map task) and is written as one
sorted run per bucket. Compaction merges sorted runs bucket by bucket, without a shuffle, so
that equal identifiers collapse to one, and writes the result as a new run. The collapse is a
maximum, so repeating a batch or running batches in another order changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrock.session import append_bucketed, scratch_path


def canonical_id(c: Column | str) -> Column:
    """An identifier without angle brackets and white space, in lower case; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.lower(F.regexp_replace(c, r"[<>\s\p{Z}]+", "")), F.lit(""))


def clean_address(c: Column) -> Column:
    """An address entry without display name, angle brackets, quotes and blanks, in lower case,
    doubled dots read as one; null for an entry without ``@``."""
    inner = F.regexp_extract(c, r"<([^<>]*@[^<>]*)>", 1)
    bare = F.when(inner != "", inner).otherwise(c)
    bare = F.lower(F.regexp_replace(F.regexp_replace(bare, r"[<>\"'\s\p{Z}]+", ""), r"\.{2,}", "."))
    return F.when(bare.contains("@"), bare)


def addresses(*lists: str) -> Column:
    """The distinct clean addresses of array columns; null lists count as empty."""
    whole = F.concat(*[F.coalesce(F.col(x), F.array().cast("array<string>")) for x in lists])
    return F.array_distinct(F.filter(F.transform(whole, clean_address), lambda x: x.isNotNull()))


class DeliveryStore:
    """The bucketed, sorted table of the best delivery per identifier.

    A run has ``cid, n_addr, neg_id``; better is the greater ``(n_addr, neg_id)``, that is most
    addresses and then the smallest row id. Runs are tables of equal buckets, each bucket sorted
    by identifier. When ``fan_in`` runs have come, or on demand, compaction merges them pairwise:
    a bucket of one run is merged with the same bucket of the other (no row is shuffled), equal
    identifiers collapse, and the merged run is written in their place. Data lie in the shared
    folder; a run's files are never changed, so a compaction that fails leaves the old runs.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = 4):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []

    @staticmethod
    def _best(df: DataFrame) -> DataFrame:
        top = F.max(F.struct("n_addr", "neg_id")).alias("b")
        return df.groupBy("cid").agg(top).select("cid", "b.n_addr", "b.neg_id")

    def _write(self, run: DataFrame) -> str:
        name = f"deliveries_{uuid.uuid4().hex}"
        append_bucketed(run, name, scratch_path(self.spark, "deliveries"), ["cid"], self.buckets, True)
        return name

    def upsert(self, batch: DataFrame) -> None:
        """Merge a batch ``(cid, n_addr, neg_id)``; rows without identifier are not stored."""
        best = self._best(batch.where(F.col("cid").isNotNull()))
        self.runs.append(self._write(best.repartition(self.buckets, "cid")))
        if len(self.runs) >= self.fan_in:
            self.compact()

    @staticmethod
    def merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """The merge of two sorted runs of distinct identifiers: equal ones collapse to the better."""
        pick = lambda x: F.struct(F.col(f"{x}.n_addr").alias("n_addr"), F.col(f"{x}.neg_id").alias("neg_id"))
        j = a.alias("a").join(b.alias("b").hint("merge"), F.col("a.cid") == F.col("b.cid"), "full_outer")
        best = F.greatest(F.when(F.col("a.cid").isNotNull(), pick("a")), F.when(F.col("b.cid").isNotNull(), pick("b")))
        return j.select(F.coalesce("a.cid", "b.cid").alias("cid"), best.alias("best")).select("cid", "best.n_addr", "best.neg_id")

    def compact(self) -> None:
        """Merge all runs into one."""
        while len(self.runs) > 1:
            old, runs = self.runs, [self.spark.table(r) for r in self.runs]
            new = [self._write(self.merged(runs[i], runs[i + 1])) for i in range(0, len(runs) - 1, 2)]
            self.runs = new + old[len(new) * 2 :]
            for name in old[: len(new) * 2]:
                self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")

    def compacted(self) -> DataFrame:
        """One row per identifier over all runs."""
        self.compact()
        if not self.runs:
            return self.spark.createDataFrame([], "cid string, n_addr int, neg_id bigint")
        return self.spark.table(self.runs[0])


def keyed_deliveries(messages: DataFrame) -> DataFrame:
    """``cid, n_addr, neg_id`` of every delivery (``cid`` null without identifier)."""
    return messages.select(
        canonical_id("message_id").alias("cid"), F.size(addresses("to", "cc")).alias("n_addr"), (-F.col("row_id")).alias("neg_id")
    )


def kept_deliveries(messages: DataFrame, batches: int = 1) -> DataFrame:
    """``(cid, row_id)`` of the kept delivery of every identifier, through the store.

    ``batches`` upserts the table in so many parts (by ``batch_id``), as a feed would; the
    result does not depend on it.
    """
    store = DeliveryStore(messages.sparkSession)
    for k in range(batches):
        part = messages if batches == 1 else messages.where(F.pmod(F.coalesce("batch_id", F.lit(0)), F.lit(batches)) == k)
        store.upsert(keyed_deliveries(part))
    return store.compacted().select("cid", (-F.col("neg_id")).alias("row_id"))


def superseded_deliveries(messages: DataFrame, batches: int = 1) -> DataFrame:
    """``row_id`` of every delivery that is not the kept one of its message.

    Kept is the row with the most distinct addresses in ``to`` and ``cc``, among equals the
    smallest ``row_id``. Defined results: a null or empty identifier agrees with nothing, so
    its row is kept; a row repeated whole (same ``row_id``) is one delivery; null arrays and
    null entries hold no address; an empty table gives no rows; other columns are not read; a
    superseded row that stands twice comes out twice.
    The anti-join is on ``row_id``, so a hot identifier does not skew it.
    """
    kept = kept_deliveries(messages, batches)
    ids = messages.where(canonical_id("message_id").isNotNull()).select("row_id").where(F.col("row_id").isNotNull())
    return ids.join(kept.select("row_id"), "row_id", "left_anti")


def current_messages(messages: DataFrame, batches: int = 1) -> DataFrame:
    """The messages without superseded deliveries; rows without identifier all stay."""
    return messages.join(superseded_deliveries(messages, batches), "row_id", "left_anti")
