"""Changes of permissions as a stream: tuples are applied and the documents they touch stamped anew.

An extension: a file source of tuple changes, one policy epoch per micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrock.model import TUPLE_COLUMNS, TUPLES, object_ref
from quillrock.operators.graph import containment_edges, objects_of, walk
from quillrock.operators.policystore import PolicyStore
from quillrock.plans.compiler import stamp_tokens

CHANGES = f"{TUPLES.replace(' not null', '')}, op string"


def touched_objects(changes: DataFrame, tuples: DataFrame, store: PolicyStore) -> DataFrame:
    """``object``: documents of changed tuples, and what the changed objects contain."""
    own = changes.where("object_ns <> 'group'").select(object_ref().alias("object")).distinct()
    down = containment_edges(tuples, store.namespaces).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    reached = walk(own.select(F.col("object").alias("root"), F.col("object").alias("node")), down, 8, "touched")
    return reached.select(F.col("node").alias("object")).distinct().join(objects_of(tuples), "object", "left_semi")


def reindex(spark: SparkSession, source: str, store: PolicyStore, checkpoint: str, sink: Callable[[DataFrame, int], None]):
    """Starts the stream; ``sink(stamped, epoch)`` gets ``object, grant_tokens`` of every batch.

    A change of group membership touches no document, since tokens name the group.
    """

    def batch(df: DataFrame, _: int) -> None:
        df = df.persist()
        keys = list(TUPLE_COLUMNS)
        epoch, _n = store.apply(df.where("op = 'write'").select(keys), df.where("op = 'delete'").select(keys))
        tuples = store.tuples()
        objects = touched_objects(df, tuples, store)
        if not objects.isEmpty():
            sink(stamp_tokens(objects, tuples, store.namespaces), epoch)
        df.unpersist()

    stream = spark.readStream.schema(CHANGES).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
