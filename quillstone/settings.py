"""Settings with their cross-field rules; read from a mapping such as the environment."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    dense_top_k: int = 20
    sparse_top_k: int = 20
    rrf_k: int = 60
    rerank_top_k: int = 8
    final_chunks: int = 6
    min_score: float = 0.0
    abstain_below: float = 0.25
    chunk_tokens: int = 700
    chunk_overlap: int = 100
    request_seconds: float = 30.0
    total_seconds: float = 90.0
    retries: int = 2
    backoff_seconds: float = 0.5
    backoff_cap_seconds: float = 8.0
    context_characters: int = 24_000
    context_tokens: int = 32_768
    output_tokens: int = 2_000
    margin_tokens: int = 2_048
    provider: str = "extractive"
    fallback: str | None = None

    def __post_init__(self) -> None:
        rules = [
            (self.chunk_tokens < 1 or not 0 <= self.chunk_overlap < self.chunk_tokens, "overlap must be nonnegative and less than the chunk size"),
            (min(self.dense_top_k, self.sparse_top_k, self.rrf_k, self.rerank_top_k, self.final_chunks) < 1, "counts must be positive"),
            (self.final_chunks > self.rerank_top_k * 9, "more final chunks than can be reranked"),
            (not 0 <= self.min_score <= 1 or not 0 <= self.abstain_below <= 1, "thresholds must lie between 0 and 1"),
            (not 0 < self.request_seconds <= self.total_seconds, "a request must end within the total time"),
            (self.retries < 0 or not 0 < self.backoff_seconds <= self.backoff_cap_seconds, "invalid retries"),
            (self.context_tokens <= self.output_tokens + self.margin_tokens, "no room for input"),
            (self.fallback is not None and self.fallback == self.provider, "fallback is the provider itself"),
        ]
        for broken, why in rules:
            if broken:
                raise ValueError(why)

    @property
    def input_tokens(self) -> int:
        return self.context_tokens - self.output_tokens - self.margin_tokens

    @classmethod
    def read(cls, source: Mapping[str, str], prefix: str = "QUILL_") -> Settings:
        kinds = {f.name: f.type for f in fields(cls)}
        found = {k: source[f"{prefix}{k.upper()}"] for k in kinds if f"{prefix}{k.upper()}" in source}
        return cls(**{k: int(v) if kinds[k] == "int" else float(v) if kinds[k] == "float" else v or None for k, v in found.items()})
