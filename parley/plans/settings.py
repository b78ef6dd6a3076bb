"""Settings from the environment, with typed defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    model_name: str = "extractive"
    temperature: float = 0.1
    max_retries: int = 2
    #: Seconds that a call may take.
    summary_seconds: float = 180
    items_seconds: float = 180
    chat_seconds: float = 120
    #: Calls that a worker has open at once, and seconds before the first retry, doubled for each further one.
    calls_at_once: int = 8
    backoff_seconds: float = 0.5
    asr_key: str = ""
    llm_key: str = ""
    upload_dir: str = "uploads"
    log_query_chars: int = 50

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None) -> Settings:
        """Upper-case names, case-sensitive; a missing one keeps its default."""
        env = os.environ if env is None else env
        given = {n: type(f.default)(env[n.upper()]) for n, f in cls.__dataclass_fields__.items() if n.upper() in env}
        return cls(**given)
