"""Answers from passages: providers in order, budgets, breakers, and the extractive fallback."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Protocol

from quillrock.functions import textmetrics as tm

# Fixed values.
BREAKER_FAILURES, BREAKER_COOLDOWN_S = 3, 60.0
EXTRACT_CLAIMS, EXTRACT_SENTENCES = 4, 2
LEDGER_DAYS = 3
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


@dataclass(frozen=True, slots=True)
class Claim:
    text: str
    chunk_ids: tuple[str, ...]


class Provider(Protocol):
    name: str

    def complete(self, prompt: str) -> str: ...


def estimate_tokens(text: str) -> int:
    return max(1, len(text) // tm.CHARS_PER_TOKEN)


def build_prompt(question: str, passages: Sequence) -> str:
    """The question first, then each passage between marks with its id."""
    parts = [f"Question: {question}", "Answer as JSON {\"claims\": [{\"text\": ..., \"chunk_ids\": [...]}]} from these passages only."]
    parts += [f"<<<PASSAGE {p.chunk_id}>>>\n{p.text}\n<<<END PASSAGE>>>" for p in passages]
    return "\n\n".join(parts)


def parse_claims(reply: str, known: set[str]) -> list[Claim] | None:
    """Claims with known ids and some text; None if the reply has no JSON of that form."""
    a, b = reply.find("{"), reply.rfind("}")
    if a < 0 or b < a:
        return None
    try:
        items = json.loads(reply[a : b + 1])["claims"]
        read = [(str(c.get("text") or "").strip(), [str(x) for x in c.get("chunk_ids") or []]) for c in items]
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    return [Claim(t, tuple(i for i in ids if i in known)) for t, ids in read if t]


def fill(passages: Sequence, budget: int) -> list:
    """In order of score: what does not fit is skipped, later and shorter passages may still fit."""
    kept, used = [], 0
    for p in sorted(passages, key=lambda p: -p.score):
        n = estimate_tokens(p.text or "")
        if used + n <= budget:
            kept.append(p)
            used += n
    return kept


def extract(question: str, passages: Sequence) -> list[Claim]:
    """The first sentences of the first passages, word for word."""
    out = []
    for p in list(passages)[:EXTRACT_CLAIMS]:
        text = " ".join(_SENTENCE.split((p.text or "").strip())[:EXTRACT_SENTENCES])
        if text:
            out.append(Claim(text, (p.chunk_id,)))
    return out


class CircuitBreaker:
    """Closed until a number of failures in a row, then open for a while, then one try."""

    def __init__(self, failures: int = BREAKER_FAILURES, cooldown: float = BREAKER_COOLDOWN_S, clock: Callable[[], float] = time.monotonic):
        self.most, self.cooldown, self.clock = failures, cooldown, clock
        self.failed, self.opened = 0, None

    @property
    def state(self) -> str:
        if self.opened is None:
            return "closed"
        return "half-open" if self.clock() - self.opened >= self.cooldown else "open"

    def allow(self) -> bool:
        return self.state != "open"

    def success(self) -> None:
        self.failed, self.opened = 0, None

    def failure(self) -> None:
        self.failed += 1
        if self.failed >= self.most or self.opened is not None:
            self.opened = self.clock()


class Ledger:
    """Tokens spent by principal and UTC day: reserved before a call, settled after it."""

    def __init__(self, per_principal: int = tm.PRINCIPAL_TOKENS_A_DAY, overall: int = tm.GLOBAL_TOKENS_A_DAY, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
        self.per_principal, self.overall, self.now = per_principal, overall, now
        self.days: dict[str, dict[str, int]] = {}
        self.lock = threading.Lock()

    def _day(self) -> dict[str, int]:
        today = self.now().strftime("%Y-%m-%d")
        day = self.days.setdefault(today, {})
        for old in sorted(self.days)[:-LEDGER_DAYS]:
            if old != today:
                del self.days[old]
        return day

    def remaining(self, principal: str) -> tuple[int, int]:
        day = self._day()
        return max(0, self.per_principal - day.get(principal, 0)), max(0, self.overall - sum(day.values()))

    def reserve(self, principal: str, tokens: int) -> Callable[[int], None] | None:
        """A settler that replaces the estimate by the actual number, or None where it does not fit."""
        with self.lock:
            mine, everyone = self.remaining(principal)
            if tokens > mine or tokens > everyone:
                return None
            day = self._day()
            day[principal] = day.get(principal, 0) + tokens

        def settle(actual: int) -> None:
            with self.lock:
                day[principal] = max(0, day[principal] - tokens + actual)

        return settle


class ProviderChain:
    """Providers in order; each behind a breaker and the ledger. Ends in extraction."""

    def __init__(self, providers: Sequence[Provider], ledger: Ledger | None = None, clock: Callable[[], float] = time.monotonic):
        self.arms = [(p, CircuitBreaker(clock=clock)) for p in providers]
        self.ledger = ledger or Ledger()

    def answer(self, principal: str, question: str, passages: Sequence) -> tuple[list[Claim], str]:
        prompt = build_prompt(question, passages)
        known = {p.chunk_id for p in passages}
        for provider, breaker in self.arms:
            if not breaker.allow():
                continue
            settle = self.ledger.reserve(principal, estimate_tokens(prompt) + tm.EXPECTED_OUTPUT_TOKENS)
            if settle is None:
                break
            try:
                reply = provider.complete(prompt)
                claims = parse_claims(reply, known)
            except Exception:
                reply, claims = "", None
            settle(estimate_tokens(prompt) + estimate_tokens(reply) if reply else 0)
            if claims is None:
                breaker.failure()
                continue
            breaker.success()
            return claims, provider.name
        return extract(question, passages), "extractive"

    def status(self) -> dict[str, str]:
        return {p.name: b.state for p, b in self.arms}
