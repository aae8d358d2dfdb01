"""The audit log: hash chains, their verification, pages, and what is counted from them.

A chain is sequential by nature, so there is one per stream (such as a principal's day): each
row commits to the row before it. Verification needs only neighbours and runs in parallel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
GENESIS = "0" * 64
PAGE_ROWS = 500
LATENCY_EDGES = (0.001, 0.005, 0.01, 0.025, 0.06, 0.1, 0.2, 0.4, 0.6, 1.0, 2.5, 5.0)


def canonical_json(**columns: Column) -> Column:
    """Sorted keys, no blanks, nulls kept."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def link(prev: Column, json: Column) -> Column:
    return F.sha2(F.concat(prev, F.lit("\n"), json), 256)


def chained(rows: DataFrame, stream: list[str]) -> DataFrame:
    """Rows (``seq, json``, and the columns of ``stream``) with ``prev`` and ``digest``.

    The rows of one stream are hashed one after the other, in order of ``seq``, as a sorted stream
    over a partition: only the last digest is held, however long a stream is.
    """
    n = len(stream)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_stream, last = None, GENESIS
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(n)))) if n else [()] * b.num_rows
            prev, digest = [], []
            for key, text in zip(keys, b.column(n + 1).to_pylist()):
                if key != open_stream:
                    open_stream, last = key, GENESIS
                prev.append(last)
                if text is not None:
                    last = hashlib.sha256(f"{last}\n{text}".encode()).hexdigest()
                digest.append(last if text is not None else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prev, pa.string()), pa.array(digest, pa.string())], names=[*b.schema.names, "prev", "digest"])

    placed = rows.select(*stream, F.col("seq").cast("bigint").alias("seq"), "json")
    placed = (placed.repartition(*stream) if n else placed.coalesce(1)).sortWithinPartitions(*stream, "seq")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema)
    return placed.mapInArrow(run, f"{kinds}, prev string, digest string")


def verified(chain: DataFrame, stream: list[str]) -> DataFrame:
    """``stream, n, first_bad, reason``: the first row that fails (null if none): a gap in ``seq``, a broken
    link, or content that does not hash to its digest."""
    w = Window.partitionBy(*stream).orderBy("seq")
    before = F.lag("digest").over(w)
    gap = F.coalesce(F.col("seq") != F.lag("seq").over(w) + 1, F.lit(False))
    broken = F.col("prev") != F.coalesce(before, F.lit(GENESIS))
    changed = F.col("digest") != link(F.col("prev"), F.col("json"))
    reason = F.when(gap, "sequence gap").when(broken, "broken link").when(changed, "content changed")
    marked = chain.withColumn("reason", reason)
    return marked.groupBy(*stream).agg(
        F.count("*").alias("n"), F.min(F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("first_bad"),
        F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("seq"))).alias("reason"),
    )


def page(rows: DataFrame, after_seq: int, limit: int = PAGE_ROWS) -> DataFrame:
    """The next rows by key; at most ``PAGE_ROWS``."""
    return rows.where(F.col("seq") > after_seq).orderBy("seq").limit(min(limit, PAGE_ROWS))


def histogram(rows: DataFrame, by: str, value: Column, edges: tuple[float, ...] = LATENCY_EDGES) -> DataFrame:
    """Cumulative counts ``by, le, n`` with the group's ``sum``; an edge belongs to its bucket, ``+Inf``
    counts all."""
    counts = [F.count_if(value <= e).alias(f"b{i}") for i, e in enumerate(edges)]
    agg = rows.where(value.isNotNull()).groupBy(by).agg(*counts, F.count("*").alias("all"), F.sum(value.cast("double")).alias("sum"))
    cells = [F.struct(F.lit(f"{e:g}").alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))
    return agg.select(by, F.inline(F.array(*cells)), "sum")


def exposition(hist: DataFrame, by: str, name: str, help_text: str = "") -> DataFrame:
    """Lines of the text format, with the sum and count of each group, and the two heads."""
    label = F.col(by).cast("string")
    cells = hist.select(F.format_string(f'{name}_bucket{{{by}="%s",le="%s"}} %d', label, "le", "n").alias("line"))
    total = hist.where("le = '+Inf'").select(
        F.explode(F.array(F.format_string(f'{name}_sum{{{by}="%s"}} %s', label, F.round("sum", 6).cast("decimal(38,6)").cast("string")), F.format_string(f'{name}_count{{{by}="%s"}} %d', label, "n"))).alias("line")
    )
    heads = hist.sparkSession.createDataFrame([(f"# HELP {name} {help_text}",), (f"# TYPE {name} histogram",)], "line string")
    return heads.unionByName(cells).unionByName(total)


def nearest_ranks(rows: DataFrame, by: str, value: str, **shares: float) -> DataFrame:
    """``by`` and, per share, the value at the nearest rank, without interpolation and exact: values
    are counted, and the counts summed in order within each group. Nulls do not count; a group of
    nothing else has nulls."""
    counted = rows.groupBy(by, value).agg(F.count(value).alias("__n"))
    group = Window.partitionBy(by)
    upto = counted.withColumn("__upto", F.sum("__n").over(group.orderBy(F.col(value).asc_nulls_first())))
    total = counted.groupBy(by).agg(F.sum("__n").alias("__all")).withColumnRenamed(by, "__by")
    ranked = upto.join(total, upto[by].eqNullSafe(F.col("__by")))
    # the rank in decimal arithmetic: 0.95 * 20 is 19, not a little more
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.col("__all").cast("decimal(20,0)") * F.lit(Decimal(str(q)))))
    return ranked.groupBy(by).agg(*[F.min(F.when((F.col("__upto") >= rank(q)) & (F.col("__n") > 0), F.col(value))).alias(name) for name, q in shares.items()])


def daily_spend(rows: DataFrame, who: str, ts: str, tokens: Column) -> DataFrame:
    """``who, day, spent``: UTC days."""
    return rows.groupBy(who, F.to_date(ts).alias("day")).agg(F.sum(tokens).alias("spent"))


def admitted(rows: DataFrame, who: str, ts: str, order: str, tokens: Column, cap: int) -> DataFrame:
    """Rows with ``spent_before`` and ``admitted``: whether a request fits what is left of its principal's
    UTC day, all earlier requests counted."""
    w = Window.partitionBy(who, F.to_date(ts)).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(tokens).over(w), F.lit(0))
    return rows.withColumn("spent_before", spent).withColumn("admitted", spent + tokens <= cap)


#: Labels that would name a person or carry a text; a metric may have none of them.
IDENTITY_LABELS = frozenset({"principal", "user", "user_id", "subject", "email", "query", "question", "text", "chunk_id", "object", "object_ref", "request_id"})


def check_labels(labels: list[str]) -> None:
    if bad := sorted(IDENTITY_LABELS & set(labels)):
        raise ValueError(f"labels that identify: {bad}")


def counters(rows: DataFrame, labels: list[str], value: Column) -> DataFrame:
    """``labels, total``: the sum per set of labels. A negative increment fails the job; nulls count nothing."""
    check_labels(labels)
    step = F.when(value < 0, F.raise_error(F.lit("a counter cannot go down"))).otherwise(F.coalesce(value, F.lit(0)))
    return rows.groupBy(*labels).agg(F.sum(step.cast("bigint")).alias("total"))
