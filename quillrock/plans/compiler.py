"""Plans: what a principal may see, as a filter that a search can apply.

All principals are compiled in one job. The strategy follows the number of reachable
objects; ids are carried only by plans that enumerate or scan them.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillrock.operators.graph import Reach, closure_of, expand_leaves
from quillrock.plans.rewrite import Namespace, default_namespaces
from quillrock.session import persisted

# Limits of the strategies.
ENUMERATE_MAX = 512
EXACT_SCAN_MAX = 4096
ENUMERATION_CAP = 50_000
CACHE_ENTRIES = 4096
#: Key of development; a deployment sets its own.
DEV_KEY = "quillrock-dev"


def grant_token(subject: Column, relation: str = "viewer", key: str = DEV_KEY) -> Column:
    """An opaque token of a subject and relation (SHA-256 mode, which SQL can compute)."""
    return F.concat(F.lit("gt_"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), subject, F.lit(relation)), 256), 1, 32))


def grant_token_keyed(subject: str, relation: str, key: bytes) -> str:
    """The same by keyed BLAKE2b of 128 bits."""
    return "gt_" + hashlib.blake2b(f"{subject}|{relation}".encode(), key=key[:64], digest_size=16).hexdigest()


def choose_strategy(n: Column, truncated: Column, corpus: Column) -> Column:
    return (
        F.when(n == 0, "enumerate")
        .when(~truncated & (corpus > 0) & (n >= corpus), "unfiltered")
        .when(truncated, "grant_tokens")
        .when(n <= ENUMERATE_MAX, "enumerate")
        .when(n <= EXACT_SCAN_MAX, "exact_scan")
        .otherwise("grant_tokens")
    )


def walk_cap(corpus: int) -> int:
    return min(ENUMERATION_CAP, max(EXACT_SCAN_MAX + 1, corpus + 1))


def compile_plans(tuples: DataFrame, corpus: int, epoch: int = 0, namespaces: dict[str, Namespace] | None = None, key: str = DEV_KEY, principals: DataFrame | None = None) -> DataFrame:
    """One plan per principal of the tuples, or per row of ``principals`` (``principal``); ids are spelled
    ``ns:id`` and sorted, empty where not carried."""
    closure = None if principals is None else closure_of(principals, tuples, namespaces or default_namespaces())
    reach = Reach(tuples, namespaces, closure=closure)
    tokens = reach.closure.groupBy("principal").agg(F.array_sort(F.collect_set(grant_token(F.col("userset"), key=key))).alias("grant_tokens"))
    cap = walk_cap(corpus)
    counted = persisted(reach.counts(), "counted")
    # Ids are only listed for principals whose plan carries them: at most EXACT_SCAN_MAX each.
    few = counted.where(F.col("n") <= min(cap, EXACT_SCAN_MAX)).select("principal")
    ids = reach.objects(few).groupBy("principal").agg(F.array_sort(F.collect_list("object")).alias("ids"))
    n = F.coalesce(F.col("n"), F.lit(0))
    p = tokens.join(counted, "principal", "left").join(ids, "principal", "left")
    strategy = choose_strategy(n, n > cap, F.lit(corpus))
    carried = F.when(strategy.isin("enumerate", "exact_scan"), F.coalesce("ids", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>"))
    return p.select(
        "principal", strategy.alias("strategy"), "grant_tokens", carried.alias("explicit_ids"), F.lit(epoch).cast("bigint").alias("epoch"),
        F.least(n, F.lit(cap)).cast("bigint").alias("estimated_cardinality"),
    )


def stamp_tokens(objects: DataFrame, tuples: DataFrame, namespaces: dict[str, Namespace] | None = None, key: str = DEV_KEY) -> DataFrame:
    """``object, grant_tokens``: the tokens of each object's granting subjects, sorted; an object
    without any has the empty set, which means nobody."""
    leaves = expand_leaves(objects, tuples, namespaces)
    stamped = leaves.groupBy("object").agg(F.array_sort(F.collect_set(grant_token(F.col("subject"), key=key))).alias("grant_tokens"))
    return objects.select("object").distinct().join(stamped, "object", "left").select("object", F.coalesce("grant_tokens", F.array().cast("array<string>")).alias("grant_tokens"))


def clamp_k(k: Column, most: int) -> Column:
    """Between 1 and ``most``."""
    return F.greatest(F.lit(1), F.least(k, F.lit(most)))


def is_stale(epoch: Column, live: int) -> Column:
    return epoch < live


# --- predicates


def bindings(strategy: Column, tokens: Column, ids: Column) -> tuple[Column, Column]:
    """Whether the token and the id condition bind: an empty set that binds admits nothing."""
    has = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    by_tokens = (strategy == "grant_tokens") | ((strategy != "unfiltered") & has(tokens))
    by_ids = (strategy == "enumerate") | ((strategy != "unfiltered") & has(ids))
    return by_tokens, by_ids


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def admits(strategy: Column, tokens: Column, ids: Column, object_ref: Column, object_id: Column, row_tokens: Column) -> Column:
    """The store's predicate: all bound conditions; with none bound only an unfiltered plan admits."""
    by_tokens, by_ids = bindings(strategy, tokens, ids)
    in_ids = F.coalesce(F.array_contains(ids, object_ref) | F.array_contains(ids, object_id), F.lit(False))
    held = (~by_tokens | overlaps(row_tokens, tokens)) & (~by_ids | in_ids)
    return F.when(strategy == "unfiltered", True).otherwise((by_tokens | by_ids) & held)


def plan_admits(strategy: Column, tokens: Column, ids: Column, object_ref: Column, row_tokens: Column) -> Column:
    """The compiler's predicate: each strategy applies its own condition only."""
    in_ids = F.coalesce(F.array_contains(ids, object_ref), F.lit(False))
    return F.when(strategy == "unfiltered", True).when(strategy == "grant_tokens", overlaps(row_tokens, tokens)).otherwise(in_ids)


def first_matching_token(row_tokens: Column, tokens: Column) -> Column:
    return F.array_min(F.array_intersect(row_tokens, tokens))


def admits_nothing(strategy: Column, tokens: Column, ids: Column) -> Column:
    by_tokens, by_ids = bindings(strategy, tokens, ids)
    empty = lambda x: F.coalesce(F.size(x), F.lit(0)) == 0
    return F.when(strategy == "unfiltered", False).otherwise((by_tokens & empty(tokens)) | (by_ids & empty(ids)) | ~(by_tokens | by_ids))


# --- cache


@dataclass(frozen=True)
class PlanKey:
    principal: str
    epoch: int
    relation: str = "viewer"
    namespace: str = "doc"


class PlanCache:
    """Least recently used plans by principal and epoch; a plan older than the live epoch is never given."""

    def __init__(self, most: int = CACHE_ENTRIES):
        self.most = most
        self._held: OrderedDict[PlanKey, dict[str, Any]] = OrderedDict()

    def get(self, key: PlanKey, live_epoch: int) -> dict[str, Any] | None:
        plan = self._held.get(key)
        if plan is None or plan["epoch"] < live_epoch:
            self._held.pop(key, None)
            return None
        self._held.move_to_end(key)
        return plan

    def put(self, key: PlanKey, plan: dict[str, Any]) -> None:
        self._held[key] = plan
        self._held.move_to_end(key)
        while len(self._held) > self.most:
            self._held.popitem(last=False)

    def __len__(self) -> int:
        return len(self._held)

