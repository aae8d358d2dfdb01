"""The tuple store: immutable snapshots by epoch, each published by a pointer file of its own.

A write makes the next snapshot as a whole and only then creates the pointer of its epoch,
without overwriting: of two writers one loses, and begins again from the other's state. A
reader takes the greatest complete pointer and gets rows, epoch and namespaces of that state.
Deletes come before writes; the epoch grows with every call, also one that changes nothing.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrock.model import TUPLE_COLUMNS, TUPLES
from quillrock.plans.rewrite import Namespace, default_namespaces
from quillrock.session import scratch_path

KEYS = list(TUPLE_COLUMNS)


def merged(base: DataFrame, writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """The tuples after deletes, then writes; a set."""
    return base.select(KEYS).join(deletes.select(KEYS), KEYS, "left_anti").unionByName(writes.select(KEYS)).dropDuplicates(KEYS)


def n_applied(base: DataFrame, writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """One row, ``n_applied``: tuples that a delete removed plus tuples that a write added after it."""
    removed = base.select(KEYS).distinct().join(deletes.select(KEYS).distinct(), KEYS, "left_semi")
    left = base.select(KEYS).join(deletes.select(KEYS), KEYS, "left_anti")
    added = writes.select(KEYS).distinct().join(left, KEYS, "left_anti")
    return removed.select(F.lit(1).alias("x")).unionAll(added.select(F.lit(1).alias("x"))).agg(F.count("*").alias("n_applied"))


def stats(tuples: DataFrame, epoch: int = 0) -> DataFrame:
    who = F.struct("principal_ns", "principal_id", "principal_rel")
    return tuples.agg(
        F.count("*").alias("tuples"), F.count_distinct(F.struct("object_ns", "object_id")).alias("objects"), F.count_distinct(who).alias("principals"),
        F.lit(epoch).cast("bigint").alias("epoch"),
    )


class Conflict(Exception):
    """Another writer published the epoch first, again and again."""


class PolicyStore:
    """A durable store in a shared folder; pointers are JSON ``{epoch, snapshot, namespaces}``."""

    ATTEMPTS = 20

    def __init__(self, spark: SparkSession, path: str | None = None, namespaces: dict[str, Namespace] | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "policy")
        self._fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._pointer() is None:
            if self._names(f"{self.path}/snapshots"):
                raise RuntimeError(f"snapshots without a pointer under {self.path}; not initialised over them")
            try:
                self._publish(spark.createDataFrame([], TUPLES), 0, namespaces or default_namespaces())
            except Conflict:  # another store was made here meanwhile
                pass

    def _names(self, path: str) -> list[str]:
        p = self._fs_path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def _pointer(self) -> dict | None:
        """The greatest pointer that is written in full."""
        for name in sorted((n for n in self._names(f"{self.path}/pointers") if n.endswith(".json")), reverse=True):
            try:
                stream = self._fs.open(self._fs_path(f"{self.path}/pointers/{name}"))
                try:
                    return json.loads(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
            except (ValueError, Py4JJavaError):  # being written
                continue
        return None

    def _publish(self, df: DataFrame, epoch: int, namespaces: dict[str, Namespace]) -> None:
        name = f"snapshots/{epoch}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.path}/{name}")
        pointer = {"epoch": epoch, "snapshot": name, "namespaces": {k: v.to_json() for k, v in namespaces.items()}}
        try:
            out = self._fs.create(self._fs_path(f"{self.path}/pointers/{epoch:012d}.json"), False)
        except Py4JJavaError as e:
            raise Conflict(epoch) from e
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()

    def state(self) -> tuple[int, DataFrame, dict[str, Namespace]]:
        """Epoch, tuples and namespaces of one published state."""
        p = self._pointer()
        rows = self.spark.read.schema(TUPLES).parquet(f"{self.path}/{p['snapshot']}")
        return p["epoch"], rows, {k: Namespace.from_json(v) for k, v in p["namespaces"].items()}

    @property
    def epoch(self) -> int:
        return self._pointer()["epoch"]

    @property
    def namespaces(self) -> dict[str, Namespace]:
        return self.state()[2]

    def tuples(self) -> DataFrame:
        return self.state()[1]

    def apply(self, writes: DataFrame | None = None, deletes: DataFrame | None = None, namespaces: dict[str, Namespace] | None = None) -> tuple[int, int]:
        """``(epoch, n_applied)``; ``namespaces`` are declared with it."""
        none = self.spark.createDataFrame([], TUPLES)
        writes, deletes = writes if writes is not None else none, deletes if deletes is not None else none
        for _ in range(self.ATTEMPTS):
            epoch, base, known = self.state()
            n = n_applied(base, writes, deletes).first()[0]
            try:
                self._publish(merged(base, writes, deletes), epoch + 1, known | (namespaces or {}))
                return epoch + 1, n
            except Conflict:
                continue
        raise Conflict(self.path)

    def write(self, tuples: DataFrame) -> int:
        return self.apply(writes=tuples)[0]

    def delete(self, tuples: DataFrame) -> int:
        return self.apply(deletes=tuples)[0]

    def define_namespace(self, ns: Namespace) -> int:
        return self.apply(namespaces={ns.name: ns})[0]

    def namespace(self, name: str) -> Namespace:
        return self.namespaces.get(name, Namespace(name))

    def list_namespaces(self) -> list[str]:
        return sorted(self.namespaces)

    def read(self, ns: str, id_: str, relation: str | None = None) -> DataFrame:
        rows = self.tuples().where((F.col("object_ns") == ns) & (F.col("object_id") == id_))
        return rows if relation is None else rows.where(F.col("relation") == relation)

    def read_by_principal(self, ns: str, id_: str, rel: str = "", relation: str | None = None) -> DataFrame:
        """By the exact principal, never a prefix of it."""
        rows = self.tuples().where((F.col("principal_ns") == ns) & (F.col("principal_id") == id_) & (F.col("principal_rel") == rel))
        return rows if relation is None else rows.where(F.col("relation") == relation)

    def list_objects(self, ns: str) -> DataFrame:
        return self.tuples().where(F.col("object_ns") == ns).select("object_id").distinct()

    def count_objects(self, ns: str) -> int:
        return self.list_objects(ns).count()

    def stats(self) -> DataFrame:
        return stats(self.tuples(), self.epoch)
