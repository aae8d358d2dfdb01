"""Schemas, and references between text and columns.

``ns:id`` is an object, ``ns:id#rel`` a principal (a userset if it has a relation), and
``ns:id#rel@principal`` a tuple. References split at their first delimiter, as ids may hold
later ones; an empty part makes a reference malformed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TUPLE_COLUMNS = ("object_ns", "object_id", "relation", "principal_ns", "principal_id", "principal_rel")
TUPLES = ", ".join(f"{c} string not null" for c in TUPLE_COLUMNS)
CHUNKS = (
    "row_id bigint, chunk_id string, object_ref string, object_id string, text string, grant_tokens array<string>, "
    "metadata map<string,string>, embedding array<float>"
)
PLANS = "principal string, strategy string, grant_tokens array<string>, explicit_ids array<string>, epoch bigint, estimated_cardinality bigint"

STRATEGIES = ("enumerate", "grant_tokens", "unfiltered", "exact_scan")


def head(c: Column, mark: str) -> Column:
    """The part before the first ``mark``, or null."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1))


def rest(c: Column, mark: str) -> Column:
    """The part after the first ``mark``, or null."""
    at = F.instr(c, mark)
    return F.when(at > 0, F.substring(c, at + 1, F.length(c)))


def object_ref(ns: str = "object_ns", id_: str = "object_id") -> Column:
    return F.concat(F.col(ns), F.lit(":"), F.col(id_))


def principal_ref(ns: str = "principal_ns", id_: str = "principal_id", rel: str = "principal_rel") -> Column:
    return F.concat(F.col(ns), F.lit(":"), F.col(id_), F.when(F.col(rel) != "", F.concat(F.lit("#"), F.col(rel))).otherwise(""))


def tuple_text() -> Column:
    return F.concat(object_ref(), F.lit("#"), F.col("relation"), F.lit("@"), principal_ref())


def parse_tuples(texts: DataFrame, column: str = "text") -> DataFrame:
    """The six columns of each text and ``valid``; the columns of a malformed text are null.

    A null text is malformed.
    """
    left, right = head(F.col(column), "@"), rest(F.col(column), "@")
    obj, relation = head(left, "#"), rest(left, "#")
    has_rel = F.instr(right, "#") > 0
    who = F.when(has_rel, head(right, "#")).otherwise(right)
    rel = F.when(has_rel, rest(right, "#")).otherwise("")
    parts = [head(obj, ":"), rest(obj, ":"), relation, head(who, ":"), rest(who, ":"), rel]
    valid = F.lit(True)
    for p in parts[:5]:
        valid = valid & F.coalesce(p != "", F.lit(False))
    valid = valid & F.when(has_rel, rel != "").otherwise(True)
    valid = F.coalesce(valid, F.lit(False))
    out = texts.withColumn("valid", valid)
    return out.select(*texts.columns, *[F.when(valid, p).alias(n) for p, n in zip(parts, TUPLE_COLUMNS)], "valid")
