"""Parameters of the operators, with the defaults and bounds of the search API."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class ChunkParams:
    chunk_tokens: int = 800
    parent_tokens: int = 1600  # 0: no cap
    strip_headings: bool = True
    carry_heading: bool = True  # a heading that was emitted alone goes to the next chunk's metadata

    def __post_init__(self):
        if self.chunk_tokens <= 0:
            raise ValueError("chunk_tokens must be positive")


def _bounded(name: str, value: int, low: int, high: int) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be in {low}..{high}, got {value}")


@dataclass(frozen=True)
class SearchParams:
    mode: str = "hybrid"  # hybrid, dense or sparse
    top_k: int = 5
    candidate_k: int = 20
    rrf_k: int = 60
    rerank: bool = True
    rerank_candidate_k: int = 20
    section: str | None = None

    def __post_init__(self):
        if self.mode not in ("hybrid", "dense", "sparse"):
            raise ValueError(f"unknown mode {self.mode!r}")
        _bounded("top_k", self.top_k, 1, 50)
        _bounded("candidate_k", self.candidate_k, 1, 200)
        _bounded("rrf_k", self.rrf_k, 1, 1000)
        _bounded("rerank_candidate_k", self.rerank_candidate_k, 1, 200)


@dataclass(frozen=True)
class ContextParams:
    context_k: int = 5
    max_context_chars: int = 6000
    source: str = "auto"  # text, window or auto
    background: bool = True

    def __post_init__(self):
        if self.source not in ("text", "window", "auto"):
            raise ValueError(f"unknown context source {self.source!r}")
        _bounded("context_k", self.context_k, 1, 20)
        _bounded("max_context_chars", self.max_context_chars, 1000, 50_000)
