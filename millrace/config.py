"""Settings of search and ingest."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Validated on construction; dataclasses.replace makes a changed copy, validated again."""

    dim: int = 1024
    relevance_threshold: float = 0.3
    top_k: int = 25
    chunk_tokens: int = 500
    overlap_tokens: int = 32
    embed_batch: int = 50
    embed_tries: int = 3
    retry_seconds: float = 1.0

    def __post_init__(self) -> None:
        for f in fields(self):
            x = getattr(self, f.name)
            if isinstance(x, bool) or not isinstance(x, (int, float)) or (f.type == "int" and not isinstance(x, int)):
                raise ValueError(f"{f.name}: {x!r} is not of type {f.type}")
            if f.name not in ("relevance_threshold", "retry_seconds", "overlap_tokens") and x <= 0 or x < 0:
                raise ValueError(f"{f.name}: {x!r} is too small")
        if self.relevance_threshold > 1:
            raise ValueError("relevance_threshold must be between 0 and 1")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "MILLRACE_") -> Settings:
        """Settings from variables like MILLRACE_TOP_K."""
        given = {f.name: env[prefix + f.name.upper()] for f in fields(cls) if prefix + f.name.upper() in env}
        return cls(**{k: (float if isinstance(getattr(cls, k), float) else int)(v) for k, v in given.items()})


def retry_delay(attempt: int, base: float = 1.0, most: float = 30.0) -> float:
    """Seconds before try number attempt + 1: doubled each time, up to a maximum."""
    return min(base * 2**attempt, most)
