"""The engine: one object over a tuple store and an index, with the calls a service would make.

Search gives unchecked hits; only what the live tuples allow becomes showable. Whether a
principal lacks evidence or lacks permission, the refusal is the same.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrock.functions import guard
from quillrock.functions import textmetrics as tm
from quillrock.generation import Claim, ProviderChain, extract
from quillrock.operators import graph
from quillrock.operators.auditlog import AuditLog
from quillrock.operators.policystore import PolicyStore
from quillrock.operators.search import Hits, Unchecked, block_top_k, permitted
from quillrock.plans import compiler
from quillrock.session import persisted

# Fixed values.
DEFAULT_K, MAX_K = 10, 50
MAX_QUESTION_CHARS = 2_000
REFUSAL_FLOOR_S = 0.060
REFUSAL_TEXT = "No answer can be given from what you may see."
REASONS = ("no_evidence_at_all", "no_permitted_evidence", "injection_detected", "ungrounded", "budget_exceeded", "stale_policy")


class EngineError(Exception):
    """A failure with a fixed public message and status; details stay inside."""

    code, status, public = "internal", 500, "Something went wrong."


class BudgetExceeded(EngineError):
    code, status, public = "budget_exceeded", 429, "The request is over its budget."


class PermissionDenied(EngineError):
    code, status, public = "permission_denied", 403, "Not permitted."


class StalePolicy(EngineError):
    code, status, public = "stale_policy", 409, "The policy changed; ask again."


class UngroundedHits(EngineError):
    code, status, public = "unchecked", 500, "Something went wrong."


class Unauthenticated(EngineError):
    code, status, public = "unauthenticated", 401, "Sign in first."


class AuthorityUnavailable(EngineError):
    code, status, public = "authority_unavailable", 503, "Try again later."


class IndexUnavailable(EngineError):
    code, status, public = "index_unavailable", 503, "Try again later."


class AuditUnavailable(EngineError):
    """Without its record nothing is answered."""

    code, status, public = "audit_unavailable", 503, "Try again later."


class Misconfigured(EngineError):
    code, status, public = "misconfigured", 500, "Something went wrong."


class ChainBroken(EngineError):
    code, status, public = "chain_broken", 500, "Something went wrong."


class NotAvailable(EngineError):
    code, status, public = "not_available", 501, "Not available here."


@dataclass
class Diagnostics:
    candidates: int = 0
    dropped: int = 0
    plan_cached: bool = False
    strategy: str = ""
    fired: str = ""
    provider: str = ""
    stage_ms: dict[str, float] = field(default_factory=dict)
    #: Whether the policy moved between the plan and the recheck.
    policy_moved: bool = False

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.stage_ms[name] = self.stage_ms.get(name, 0.0) + (time.perf_counter() - began) * 1000


@dataclass
class Answer:
    refused: bool
    text: str
    citations: list[str]
    #: For the audit log only; it never leaves with the answer.
    reason: str = ""
    diagnostics: Diagnostics = field(default_factory=Diagnostics)

    def public(self) -> dict[str, Any]:
        return {"refused": self.refused, "text": self.text, "citations": self.citations}


def refuse(reason: str, diagnostics: Diagnostics | None = None) -> Answer:
    """The one constructor of refusals: the same text, whatever the reason."""
    return Answer(True, REFUSAL_TEXT, [], reason, diagnostics or Diagnostics())


def showable(hits: Hits | Unchecked) -> DataFrame:
    if not isinstance(hits, Hits):
        raise UngroundedHits("hits were not rechecked")
    return hits.rows


def validate(question: str, k: int) -> None:
    """Refuses what is blank or over a cap; nothing is trimmed."""
    if not question.strip() or len(question) > MAX_QUESTION_CHARS or not 1 <= k <= MAX_K:
        raise BudgetExceeded(f"question of {len(question)} characters, k {k}")


class Engine:
    def __init__(self, spark: SparkSession, store: PolicyStore, chunks: DataFrame, providers: ProviderChain | None = None, floor_s: float = REFUSAL_FLOOR_S, audit: AuditLog | None = None, audit_key: bytes = b""):
        self.spark, self.store, self.chunks = spark, store, chunks
        self.cache = compiler.PlanCache()
        self.providers = providers or ProviderChain([])
        self.floor_s = floor_s
        self.audit, self.audit_key = audit or AuditLog(spark), audit_key

    # --- plans

    def plan(self, principal: str, diagnostics: Diagnostics | None = None) -> dict[str, Any]:
        """The plan at the live epoch, read before the walk; compiled once more if it is stale by then."""
        for _ in range(2):
            epoch = self.store.epoch
            key = compiler.PlanKey(principal, epoch)
            plan = self.cache.get(key, epoch)
            if diagnostics:
                diagnostics.plan_cached = plan is not None
            if plan is None:
                tuples = self.store.tuples()
                corpus = graph.objects_of(tuples).count()
                one = self.spark.createDataFrame([(principal,)], "principal string")
                plan = compiler.compile_plans(tuples, corpus, epoch, self.store.namespaces, principals=one).first().asDict()
                self.cache.put(key, plan)
            if plan["epoch"] >= self.store.epoch:
                return plan
        raise StalePolicy(principal)

    def plan_summary(self, principal: str) -> dict[str, Any]:
        """Counts, never tokens or ids."""
        p = self.plan(principal)
        return {"strategy": p["strategy"], "n_tokens": len(p["grant_tokens"]), "n_ids": len(p["explicit_ids"]), "epoch": p["epoch"], "cardinality": p["estimated_cardinality"]}

    def epoch(self) -> int:
        return self.store.epoch

    # --- authority

    def check(self, obj: str, principal: str, relation: str = "viewer", max_depth: int = graph.MAX_DEPTH) -> bool:
        one = self.spark.createDataFrame([(obj, principal)], "object string, principal string")
        return not graph.check_hits(one, self.store.tuples(), self.store.namespaces, relation, max_depth).isEmpty()

    def explain(self, obj: str, principal: str, relation: str = "viewer") -> DataFrame:
        """The expansion of the object, with ``names`` true where the principal's closure meets a subject."""
        one = self.spark.createDataFrame([(obj,)], "object string")
        tuples = self.store.tuples()
        mine = graph.principal_closure(tuples, self.store.namespaces).where(F.col("principal") == principal).agg(F.collect_set("userset").alias("mine"))
        nodes = graph.expand_nodes(one, tuples, self.store.namespaces, relation)
        return nodes.crossJoin(F.broadcast(mine)).withColumn("names", F.arrays_overlap("subjects", "mine")).drop("mine")  # one row

    def require_admin(self, principal: str) -> None:
        if not self.check("system:policy", principal, "admin"):
            raise PermissionDenied(principal)

    def apply(self, admin: str, writes: DataFrame | None = None, deletes: DataFrame | None = None) -> tuple[int, int]:
        self.require_admin(admin)
        return self.store.apply(writes, deletes)

    # --- search

    def search(self, principal: str, vector: list[float], k: int = DEFAULT_K, diagnostics: Diagnostics | None = None) -> Unchecked:
        top = block_top_k(permitted(self.chunks, self.plan(principal, diagnostics)), [(0, vector, None)], k)
        return Unchecked(top.join(self.chunks.select("row_id", "chunk_id", "object_ref", "text"), "row_id").withColumn("principal", F.lit(principal)))

    def recheck(self, hits: Unchecked) -> tuple[Hits, int]:
        """What the live tuples allow, in the order it came, and how many hits were dropped."""
        epoch = self.store.epoch
        rows = persisted(hits.rows, "hits")
        pairs = rows.select(F.col("object_ref").alias("object"), "principal").where("object is not null")
        checked = persisted(graph.recheck(rows, graph.check_hits(pairs, self.store.tuples(), self.store.namespaces)), "checked")
        return Hits(checked.where("kept").drop("kept").orderBy("rank"), epoch), checked.where("not kept").count()

    def retrieve(self, principal: str, vector: list[float], k: int = DEFAULT_K) -> tuple[Hits, Diagnostics]:
        """Plan, search, recheck, recorded in the audit log; no answer is made."""
        d = Diagnostics()
        validate("search", k)
        with d.stage("plan"):
            plan = self.plan(principal, d)
        d.strategy = plan["strategy"]
        with d.stage("recheck"):
            hits, d.dropped = self.recheck(self.search(principal, vector, k, d))
        d.policy_moved = hits.epoch != plan["epoch"]
        shown = [r.object_ref for r in showable(hits).select("object_ref").collect()]  # at most MAX_K
        d.candidates = len(shown) + d.dropped
        self._record("search", principal, "", d, shown, "")
        return hits, d

    def _record(self, route: str, principal: str, question: str, d: Diagnostics, shown: list[str], reason: str) -> None:
        try:
            self.audit.append([
                {
                    "ts": time.time(), "route": route, "principal": principal, "query_hash": question_hash(question, self.audit_key) if question else "", "refusal_reason": reason,
                    "n_candidates": d.candidates, "n_dropped_at_recheck": d.dropped, "strategy": d.strategy, "epoch": self.store.epoch, "shown_objects": list(dict.fromkeys(shown)),
                    "guardrails_fired": [d.fired] if d.fired else [], "provider": d.provider, "degraded": d.provider == "extractive",
                }
            ])
        except (OSError, RuntimeError) as e:
            raise AuditUnavailable(str(e)) from e

    def ask(self, principal: str, question: str, vector: list[float], k: int = DEFAULT_K) -> Answer:
        """Plan, search, recheck, scan, answer, ground, cite; a refusal takes a least time."""
        *_, last = self.events(principal, question, vector, k)
        return last["result"]

    def events(self, principal: str, question: str, vector: list[float], k: int = DEFAULT_K) -> Iterator[dict[str, Any]]:
        """The stages of an answer as they end, ``{"stage", "ms"}``, and last ``{"result"}``."""
        began = time.monotonic()
        d = Diagnostics()
        try:
            validate(question, k)
            answer = None
            for step in self._stages(principal, question, vector, k, d):
                if isinstance(step, Answer):
                    answer = step
                else:
                    yield {"stage": step, "ms": round(d.stage_ms[step], 3)}
        except BudgetExceeded:
            answer = refuse("budget_exceeded", d)
        if answer.refused:
            time.sleep(max(0.0, self.floor_s - (time.monotonic() - began)))
        self._record("ask", principal, question, d, answer.citations, answer.reason)
        yield {"result": answer}

    def _stages(self, principal: str, question: str, vector: list[float], k: int, d: Diagnostics) -> Iterator[str | Answer]:
        """The name of each stage when it is done, and at last the answer."""
        with d.stage("plan"):
            plan = self.plan(principal, d)
        d.strategy = plan["strategy"]
        yield "plan"
        if plan["strategy"] != "unfiltered" and not plan["grant_tokens"] and not plan["explicit_ids"]:
            yield refuse("no_evidence_at_all", d)
            return
        with d.stage("search"):
            found = self.search(principal, vector, k, d)
        yield "search"
        with d.stage("recheck"):
            hits, d.dropped = self.recheck(found)
            rows = showable(hits).select("chunk_id", "object_ref", "text", "score").collect()  # at most MAX_K
        d.policy_moved = hits.epoch != plan["epoch"]
        d.candidates = len(rows) + d.dropped
        yield "recheck"
        if not rows:
            yield refuse("no_permitted_evidence" if d.dropped else "no_evidence_at_all", d)
            return
        with d.stage("guardrails"):
            texts = self.spark.createDataFrame([(i, r.text or "") for i, r in enumerate(rows)], "i int, text string")
            fired = texts.select("i", guard.injection_name(F.col("text")).alias("rule")).where("rule is not null").orderBy("i").limit(1).collect()
        yield "guardrails"
        if fired:
            d.fired = fired[0].rule
            yield refuse("injection_detected", d)
            return
        with d.stage("generate"):
            if sum(len(r.text or "") for r in rows) + tm.CONTEXT_OVERHEAD * len(rows) > tm.MAX_CONTEXT_CHARS:
                claims, d.provider = extract(question, rows), "extractive"
            else:
                claims, d.provider = self.providers.answer(principal, question, rows)
        yield "generate"
        with d.stage("ground"):
            answer = self._grounded(claims, {r.chunk_id: r for r in rows}, d)
        yield "ground"
        yield answer

    def _grounded(self, claims: list[Claim], known: dict[str, Any], d: Diagnostics) -> Answer:
        """The claims that cite what was shown and are supported by it."""
        cited = [Claim(c.text, tuple(i for i in c.chunk_ids if i in known)) for c in claims]
        cited = [c for c in cited if c.chunk_ids]
        if not cited:
            return refuse("ungrounded", d)
        pairs = self.spark.createDataFrame([(i, c.text, " ".join(known[x].text or "" for x in c.chunk_ids)) for i, c in enumerate(cited)], "i int, claim string, evidence string")
        scores = {r.i: r.s for r in pairs.select("i", tm.support_score(F.col("claim"), F.col("evidence")).alias("s")).collect()}
        kept = [c for i, c in enumerate(cited) if scores[i] >= tm.MIN_SUPPORT]
        if not kept:
            return refuse("ungrounded", d)
        return Answer(False, " ".join(c.text for c in kept), list(dict.fromkeys(known[i].object_ref for c in kept for i in c.chunk_ids)), "", d)


def question_hash(question: str, key: bytes = b"") -> str:
    """Of the question with blanks squeezed, in lower case; keyed where there is a key."""
    import hashlib
    import hmac

    squeezed = b"quillrock/query/v1\n" + " ".join(question.split()).lower().encode()
    if key:
        return "k:" + hmac.new(key, squeezed, hashlib.sha256).hexdigest()[:32]
    return "u:" + hashlib.sha256(squeezed).hexdigest()[:32]
