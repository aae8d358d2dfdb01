"""Settings of a deployment, checked when they are made."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

#: Parts of names that would switch a control off; a setting so named cannot exist.
SWITCHES = ("disable", "bypass", "skip", "allow_all", "unsafe", "no_recheck")
BACKENDS = ("parquet", "memory")
PREFIX = "QUILLROCK_"


@dataclass(frozen=True)
class Settings:
    environment: str = "development"
    shared_folder: str = ""
    index_backend: str = "parquet"
    token_key: str = ""
    audit_key: str = ""
    jwks_url: str = ""
    max_k: int = 50
    max_question_chars: int = 2_000
    check_depth: int = 16
    refusal_floor_ms: int = 60

    def __post_init__(self) -> None:
        for f in fields(self):
            if any(s in f.name for s in SWITCHES):
                raise ValueError(f"{f.name}: no setting may switch a control off")
        if self.index_backend not in BACKENDS:
            raise ValueError(f"index_backend is one of {BACKENDS}; searching first and filtering after is no backend")
        if self.environment == "production":
            for name in ("shared_folder", "token_key", "audit_key", "jwks_url"):
                if not getattr(self, name):
                    raise ValueError(f"{name} must be set in production")
        for name in ("max_k", "max_question_chars", "check_depth"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.refusal_floor_ms < 0:
            raise ValueError("refusal_floor_ms must not be negative")

    def grant_key(self) -> str:
        """The key of grant tokens; only development has one of its own."""
        from quillrock.plans.compiler import DEV_KEY

        if self.token_key:
            return self.token_key
        if self.environment == "development":
            return DEV_KEY
        raise ValueError("token_key must be set outside development")


def load(environment: dict[str, str] | None = None) -> Settings:
    """From ``QUILLROCK_*`` variables; an unknown one raises, as it may be a misspelt control."""
    given = {k[len(PREFIX) :].lower(): v for k, v in (os.environ if environment is None else environment).items() if k.startswith(PREFIX)}
    kinds = {f.name: f.type for f in fields(Settings)}
    if unknown := sorted(set(given) - set(kinds)):
        raise ValueError(f"unknown settings: {unknown}")
    return Settings(**{k: int(v) if kinds[k] == "int" else v for k, v in given.items()})
