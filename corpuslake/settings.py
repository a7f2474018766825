"""Defaults of the engine (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    retrieval_k: int = 5
    chunk_target: int = 1000
    chunk_overlap: int = 150
    chunk_hard_max: int = 6000
    context_tokens: int = 6000
    answer_tokens: int = 400
    temperature: float = 0.0
    max_pages: int = 40
    artifact_max_age_hours: int = 720
    use_retrieval_queries: bool = True
    embedding_model: str = "hash-384"
    embedding_dimensions: int = 384
    user_agent: str = "corpuslake"

    @property
    def chunk_min(self) -> int:
        return self.chunk_target * 8 // 10

    @property
    def chunk_max(self) -> int:
        return self.chunk_target * 12 // 10


DEFAULTS = Settings()
