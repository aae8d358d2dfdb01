"""Items that appear together: how often each pair shares a basket, and how much more than by chance.

An incremental pair table. Baskets are upserted by their key; where the content of a basket
changes, its old items count -1 and its new items +1. From these signed baskets come signed
deltas of three persistent tables: the number of baskets, the count of every item (marginals)
and the count of every pair, the latter two hash-bucketed with one run per batch. Reading sums
the runs of a bucket, without a shuffle, so counts merge in any order. Association rows
``(a, b, n_ab, n_a, n_b)`` are kept in a fourth table; scoring computes anew only the pairs whose
own count, or one of whose marginals, moved since the last scoring. The number of baskets enters
every score alike and is applied on reading, as are the wanted count and lift, which a later
delta may cross in both directions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrock.session import append_bucketed, persisted, scratch_path

#: Baskets with more items are split into blocks of so many, and their block pairs spread over tasks.
BLOCK = 256
#: At most so many items hold more than this part of all occurrences each: only these are broadcast.
HOT_ITEMS = 1_000


def basket_items(items: Column) -> Column:
    """The items of a basket as a sorted set; nulls and repeats are dropped, a null list is empty."""
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull()))), F.array().cast("array<string>"))


def pairs_of(baskets: DataFrame) -> DataFrame:
    """``a, b, n`` (a < b) of baskets ``items`` (sorted, distinct), ``n``."""
    small = baskets.where(F.size("items") <= BLOCK).select("items", "n", F.posexplode("items").alias("i", "a"))
    small = small.select("a", F.explode(F.slice("items", F.col("i") + 2, BLOCK)).alias("b"), "n")
    last = F.floor((F.size("items") - 1) / BLOCK)
    big = baskets.where(F.size("items") > BLOCK).select(
        "n", F.posexplode(F.transform(F.sequence(F.lit(0).cast("bigint"), last), lambda k: F.slice("items", (k * BLOCK + 1).cast("int"), BLOCK))).alias("k", "block"), "items"
    )
    big = big.select("n", "block", "k", F.explode(F.sequence(F.col("k").cast("bigint"), last)).alias("k2"), "items")
    big = big.select("n", "block", (F.col("k2") == F.col("k")).alias("same"), F.slice("items", (F.col("k2") * BLOCK + 1).cast("int"), BLOCK).alias("other"))
    big = big.repartition(F.xxhash64("block", "other")).select("n", F.explode("block").alias("a"), "same", "other")
    big = big.select("a", F.explode("other").alias("b"), "n", "same").where("not same or a < b").select("a", "b", "n")
    return small.unionByName(big)


class _Runs:
    """A bucketed table in the shared folder: one sorted run per append, each named by its number."""

    def __init__(self, spark: SparkSession, kind: str, schema: str, keys: list[str], buckets: int):
        self.spark, self.schema, self.keys, self.buckets = spark, schema, keys, buckets
        self.name, self.path, self.count = f"{kind}_{uuid.uuid4().hex}", scratch_path(spark, kind), 0

    def append(self, df: DataFrame) -> None:
        placed = df.withColumn("run", F.lit(self.count)).repartition(self.buckets, *self.keys)
        append_bucketed(placed, self.name, self.path, self.keys, self.buckets, not self.count)
        self.count += 1

    def rows(self, since: int = 0) -> DataFrame:
        if not self.count:
            return self.spark.createDataFrame([], self.schema + ", run int")
        self.spark.catalog.refreshTable(self.name)
        rows = self.spark.table(self.name)
        return rows.where(F.col("run") >= since) if since else rows

    def summed(self) -> DataFrame:
        """The merged counts; equal keys share a bucket, so nothing is shuffled."""
        return self.rows().groupBy(*self.keys).agg(F.sum("n").alias("n")).where("n <> 0")


class PairTable:
    """Persistent counts of baskets, items and pairs, and the association rows of the pairs.

    ``min_count``: pairs in fewer baskets have no association row (their counts are kept).
    """

    def __init__(self, spark: SparkSession, min_count: int = 1, buckets: int | None = None):
        self.spark, self.min_count = spark, min_count
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.baskets = _Runs(spark, "baskets", "basket string, version struct<x:bigint,y:bigint>, items array<string>", ["basket"], self.buckets)
        self.items = _Runs(spark, "itemcounts", "item string, n bigint", ["item"], self.buckets)
        self.pairs = _Runs(spark, "paircounts", "a string, b string, n bigint", ["a", "b"], self.buckets)
        self.total = 0
        self.scored = 0  # runs whose deltas the association rows hold already
        self.associations: DataFrame | None = None

    def upsert(self, batch: DataFrame) -> None:
        """Take in ``(basket string, version struct<x:bigint,y:bigint>, items array<string>)``.

        A basket's content is that of its greatest version ever taken in (of equal ones the greater
        list of items), so a batch may be repeated and batches may come in any order. Rows
        without a key are not taken; an empty basket counts for nothing.
        """
        new = batch.where(F.col("basket").isNotNull()).select("basket", F.struct("version", basket_items(F.col("items")).alias("items")).alias("v"))
        new = new.groupBy("basket").agg(F.max("v").alias("new"))
        if self.baskets.count:
            old = self.baskets.rows().groupBy("basket").agg(F.max(F.struct("version", "items")).alias("old"))
            new = new.join(old, "basket", "left").where("old is null or new > old")
        else:
            new = new.withColumn("old", F.lit(None).cast("struct<version:struct<x:bigint,y:bigint>,items:array<string>>"))
        changed = persisted(new, "changed")
        self.baskets.append(changed.select("basket", "new.version", "new.items"))
        differs = changed.where(F.col("old").isNull() | (F.col("new.items") != F.col("old.items")))
        signed = F.array(F.struct(F.col("new.items").alias("items"), F.lit(1).cast("bigint").alias("sign")), F.struct(F.col("old.items").alias("items"), F.lit(-1).cast("bigint").alias("sign")))
        self.apply(differs.select(F.inline(signed)))

    def apply(self, changes: DataFrame) -> None:
        """Merge signed baskets ``(items array<string>, sign)`` into the three tables of counts.

        Equal baskets are counted first: they emit their items and pairs once, with that weight,
        and what came and went within the batch emits nothing.
        """
        sets = changes.select(basket_items(F.col("items")).alias("items"), F.col("sign").cast("bigint").alias("sign")).where(F.size("items") > 0)
        net = persisted(sets.groupBy("items").agg(F.sum("sign").alias("n")).where("n <> 0"), "signed")
        self.total += net.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        items = net.select(F.explode("items").alias("item"), "n").groupBy("item").agg(F.sum("n").alias("n")).where("n <> 0")
        self.items.append(items)
        self.pairs.append(pairs_of(net).groupBy("a", "b").agg(F.sum("n").alias("n")).where("n <> 0"))

    def _with_marginals(self, pairs: DataFrame) -> DataFrame:
        """Add ``n_a, n_b``. Items that hold more than a ``HOT_ITEMS``-th of all occurrences, fewer than
        ``HOT_ITEMS`` by that, are broadcast; pairs of such an item are spread over the tasks."""
        marginal = persisted(self.items.summed(), "marginals")
        most = marginal.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / HOT_ITEMS
        hot, cold = marginal.where(F.col("n") > most), marginal.where(F.col("n") <= most)
        for x, other in (("a", "b"), ("b", "a")):
            pairs = pairs.join(F.broadcast(hot.select(F.col("item").alias(x), F.col("n").alias("__hot"))), x, "left")
            key = F.when(F.col("__hot").isNull(), F.col(x)).otherwise(F.concat(F.lit("\0"), other))
            pairs = pairs.withColumn("__key", key).join(cold.select(F.col("item").alias("__key"), F.col("n").alias("__cold")), "__key", "left")
            pairs = pairs.withColumn(f"n_{x}", F.coalesce("__hot", "__cold")).drop("__key", "__hot", "__cold")
        return pairs.select("a", "b", "n_ab", "n_a", "n_b")

    def rescore(self) -> DataFrame:
        """Bring the association rows up to date; returns the ``(a, b)`` that were computed anew."""
        counts = self.pairs.summed().select("a", "b", F.col("n").alias("n_ab"))
        if self.associations is None:
            affected = None
            fresh = counts
        else:
            moved = self.pairs.rows(self.scored).select("a", "b")
            items = persisted(self.items.rows(self.scored).select("item").distinct(), "moveditems")
            known = self.associations.select("a", "b").unionByName(counts.where(F.col("n_ab") >= self.min_count).select("a", "b"))
            by = [known.join(items.select(F.col("item").alias(x)), x, "left_semi") for x in ("a", "b")]
            affected = persisted(moved.unionByName(by[0]).unionByName(by[1]).distinct(), "affected")
            fresh = counts.join(affected, ["a", "b"], "left_semi")
        fresh = self._with_marginals(fresh.where(F.col("n_ab") >= self.min_count))
        if affected is not None:
            fresh = self.associations.join(affected, ["a", "b"], "left_anti").unionByName(fresh)
        self.associations = persisted(fresh, "associations")
        self.scored = self.pairs.count
        return affected if affected is not None else self.associations.select("a", "b")

    def scores(self, min_lift: float) -> DataFrame:
        """``item_a, item_b, n_ab, n_a, n_b, n`` (a < b) with ``n_ab >= min_count`` and
        ``n_ab * n / (n_a * n_b) >= min_lift``, up to the last batch."""
        if self.associations is None or self.scored < self.pairs.count:
            self.rescore()
        lift = F.col("n_ab").cast("decimal(38,0)") * F.lit(self.total) >= F.lit(min_lift).cast("decimal(9,4)") * F.col("n_a") * F.col("n_b")
        return self.associations.where(lift).select(F.col("a").alias("item_a"), F.col("b").alias("item_b"), "n_ab", "n_a", "n_b", F.lit(self.total).alias("n"))


def message_baskets(messages: DataFrame) -> DataFrame:
    """The baskets of deliveries: addresses in ``to`` and ``cc`` by message, best delivery first.

    A message without identifier is a basket of its own.
    """
    from quillrock.operators.deliveries import addresses, canonical_id

    cid = canonical_id("message_id")
    key = F.when(cid.isNotNull(), F.concat(F.lit("i"), cid)).otherwise(F.concat(F.lit("r"), F.col("row_id").cast("string")))
    rows = messages.select(key.alias("basket"), addresses("to", "cc").alias("items"), "row_id")
    version = F.struct(F.size("items").cast("bigint").alias("x"), (-F.col("row_id")).cast("bigint").alias("y"))
    return rows.select("basket", version.alias("version"), "items")
