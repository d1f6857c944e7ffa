"""Every parameter of the engine in one frozen, validated object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    dense_candidates: int = 20
    sparse_candidates: int = 20
    final_k: int = 8
    rrf_k: int = 60
    context_budget: int = 4000
    cache_threshold: float = 0.95
    lexical_threshold: float = 0.5
    expansion_hops: int = 1
    expansion_decay: float = 0.5
    blast_hops: int = 2
    review_hops: int = 1
    window_lines: int = 50
    window_overlap: float = 0.2
    parent_lines: int = 50
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    embedding_width: int = 64
    max_file_bytes: int = 2 * 1024 * 1024
    finding_band: int = 2
    # stage switches
    use_hybrid: bool = True
    use_graph: bool = True
    use_rerank: bool = True
    use_parents: bool = True
    use_cache: bool = True

    def __post_init__(self) -> None:
        for name in ("dense_candidates", "sparse_candidates", "final_k", "rrf_k", "context_budget", "expansion_hops", "window_lines", "parent_lines", "embedding_width", "max_file_bytes"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in ("blast_hops", "review_hops", "finding_band"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if not 0 < self.expansion_decay < 1:
            raise ValueError("expansion_decay must lie between 0 and 1")
        if not 0 <= self.window_overlap < 1:
            raise ValueError("window_overlap must lie in [0, 1)")

    @property
    def window_step(self) -> int:
        return max(1, self.window_lines - int(self.window_lines * self.window_overlap))
