"""Settings as immutable records; change one with ``dataclasses.replace``."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class RankingWeights:
    """Weights of the ranking signals, each within [0, 2] (fixed defaults)."""

    bm25: float = 0.40
    title: float = 0.25
    phrase: float = 0.15
    pagerank: float = 0.10
    freshness: float = 0.05
    quality: float = 0.05
    spam: float = 0.50

    def updated(self, **changes: float | None) -> RankingWeights:
        """A copy with the given weights; None leaves one as it is."""
        known = {f.name for f in fields(self)}
        for name, value in changes.items():
            if name not in known:
                raise ValueError(f"no weight is called {name}")
            if value is not None and not 0 <= value <= 2:
                raise ValueError(f"{name} must lie within 0 and 2")
        return replace(self, **{k: v for k, v in changes.items() if v is not None})


@dataclass(frozen=True)
class Settings:
    """Fixed defaults of scoring, graph, frontier and snippets."""

    k1: float = 1.2
    b: float = 0.75
    damping: float = 0.85
    rounds: int = 50
    tolerance: float = 1e-6
    snippet_length: int = 240
    max_depth: int = 5
    per_domain: int = 2
    crawl_delay: float = 1.0
    images_per_page: int = 15
    safe_search_limit: float = 0.7
    near_distance: int = 3
    search_ttl: int = 3600
    suggest_ttl: int = 86400
    robots_ttl: int = 86400
