"""Settings of the engine; every operator takes what it needs as a parameter with these defaults."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # fixed values of the ranking formulas
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    title_boost: float = 0.5
    pagerank_weight: float = 0.3
    pagerank_damping: float = 0.85
    pagerank_iterations: int = 100
    pagerank_tolerance: float = 1e-6
    semantic_pagerank_weight: float = 0.3
    semantic_top_k: int = 100
    rrf_k: int = 60
    rrf_pool: int = 100
    search_limit: int = 100
    snippet_length: int = 150
    snippet_words: int = 35
    snippet_step: int = 3
    cache_size: int = 1000
    cache_seconds: int = 3600
    embedding_dim: int = 384
    default_length: int = 100
    #: Phrases suggested in any case, and words that count as spelled rightly in any case.
    seed_phrases: tuple[str, ...] = (
        "lecture notes", "past exam papers", "reading list", "course overview", "learning outcomes", "search and sorting", "data structures", "operating systems",
    )
    common_words: tuple[str, ...] = (
        "algorithm", "assignment", "computer", "course", "database", "exam", "learning", "lecture", "network", "notes", "programming", "science", "structure", "syllabus", "system",
    )
    #: Parts of host names that a crawl may enter besides the host of its first seed.
    crawl_hosts: tuple[str, ...] = field(default=())


DEFAULTS = Settings()
