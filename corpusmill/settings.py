"""Options of the engine, from the environment where a variable is set."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

TRUE = {"1", "true", "yes", "on"}
LEAST = {"max_pages": 1, "delay_seconds": 0, "timeout_seconds": 1}


@dataclass(frozen=True)
class Settings:
    database: str = "corpus"
    subject: str = "all"
    index_all: bool = False
    max_pages: int = 300
    delay_seconds: float = 0.75
    timeout_seconds: float = 30.0
    chat_model: str = "chat"
    embedding_model: str = "m1"
    site: str = "site.example"
    mirror: str = "mirror.example"
    mirrored_prefix: str = "/alumno/"


def from_environment(env: Mapping[str, str] | None = None, prefix: str = "CORPUSMILL_") -> Settings:
    """Numbers below the least allowed become that; a bool is true for 1, true, yes and on in any case."""
    env = os.environ if env is None else env
    found = {}
    for f in fields(Settings):
        raw = env.get(prefix + f.name.upper())
        if raw is None:
            continue
        kind = type(f.default)
        value = raw.strip().lower() in TRUE if kind is bool else kind(raw)
        found[f.name] = max(kind(LEAST[f.name]), value) if f.name in LEAST else value
    return Settings(**found)
