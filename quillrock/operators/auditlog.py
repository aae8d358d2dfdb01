"""The audit log as a sink: redacted, hash-chained rows, appended without overwriting.

A record is reduced to the fixed fields, its texts are redacted, and only then hashed and
chained. Every append is one file of JSON lines, named by its first sequence number and
created without overwriting, so of two writers one finds the number taken and goes on from the
other's tail. A line that cannot be read fails the log instead of being passed over.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrock.functions.guard import audit_redacted_text
from quillrock.operators import audit
from quillrock.session import scratch_path

# The fields of a record, and what stands where one is missing.
FIELDS: dict[str, Any] = {
    "ts": 0.0, "route": "", "request_id": "", "principal": "", "query_hash": "", "strategy": "", "epoch": 0, "n_candidates": 0, "n_dropped_at_recheck": 0,
    "retrieved_objects": [], "shown_objects": [], "guardrails_fired": [], "refusal_reason": "", "provider": "", "degraded": False,
}


def to_row(record: dict[str, Any]) -> dict[str, Any]:
    """The fixed fields only, redacted; a field that is not one of them raises."""
    if unknown := sorted(set(record) - set(FIELDS)):
        raise ValueError(f"not fields of an audit record: {unknown}")
    clean = lambda v: audit_redacted_text(v) if isinstance(v, str) else [clean(x) for x in v] if isinstance(v, (list, tuple)) else v
    return {k: clean(record.get(k, default)) for k, default in FIELDS.items()}


def canonical(row: dict[str, Any]) -> str:
    """Sorted keys, no blanks, everything beyond ASCII escaped."""
    return json.dumps(row, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


class AuditLog:
    ATTEMPTS = 20

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "audit")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _files(self) -> list[str]:
        p = self._path(self.path)
        return sorted(s.getPath().toString() for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def tail(self) -> tuple[int, str]:
        """Sequence number and digest of the last row; raises where its line cannot be read."""
        files = self._files()
        if not files:
            return 0, audit.GENESIS
        stream = self._fs.open(self._path(files[-1]))
        try:
            last = bytes(stream.readAllBytes()).decode().rstrip("\n").rsplit("\n", 1)[-1]
        finally:
            stream.close()
        row = json.loads(last)
        return row["seq"], row["digest"]

    def append(self, records: Iterable[dict[str, Any]]) -> int:
        """The sequence number of the last row."""
        texts = [canonical(to_row(r)) for r in records]
        for _ in range(self.ATTEMPTS if texts else 0):
            seq, digest = self.tail()
            lines = []
            for n, text in enumerate(texts, seq + 1):
                prev, digest = digest, hashlib.sha256(f"{digest}\n{text}".encode()).hexdigest()
                lines.append(json.dumps({"seq": n, "prev": prev, "digest": digest, "json": text}) + "\n")
            try:
                out = self._fs.create(self._path(f"{self.path}/{seq + 1:015d}.jsonl"), False)
            except Py4JJavaError:  # another writer was first
                continue
            out.write(bytearray("".join(lines).encode()))
            out.close()
            return seq + len(texts)
        if texts:
            raise RuntimeError(f"audit log {self.path} is written by others again and again")
        return self.tail()[0]

    def rows(self) -> DataFrame:
        """``seq, prev, digest, json``; a malformed line fails the read."""
        schema = "seq bigint, prev string, digest string, json string"
        if not self._files():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("mode", "FAILFAST").json(self.path)

    def records(self) -> DataFrame:
        """The rows with the fields of their records."""
        kinds = {float: "double", str: "string", int: "bigint", list: "array<string>", bool: "boolean"}
        schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in FIELDS.items())
        return self.rows().select("seq", F.from_json("json", schema).alias("r")).select("seq", "r.*")

    def page(self, after_seq: int = 0, limit: int = audit.PAGE_ROWS) -> dict[str, Any]:
        """The next rows, and whether the whole chain holds."""
        bad = audit.verified(self.rows(), []).first()
        rows = [r.asDict() for r in audit.page(self.records(), after_seq, limit).collect()]
        return {"rows": rows, "verified": bad is None or bad["first_bad"] is None, "first_bad": bad and bad["first_bad"], "reason": bad and bad["reason"]}
