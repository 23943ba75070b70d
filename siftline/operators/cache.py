"""Results of past searches, kept on the driver."""

from __future__ import annotations

import time
from collections import OrderedDict
from typing import Any

from siftline.config import DEFAULTS


def cache_key(query: str, page: int = 1, per_page: int = 10, ranking: str = "bm25", domain: str | None = None) -> str:
    """The same string for searches that differ in capitals and outer white space only."""
    return f"{query.strip().lower()}|p={page}|n={per_page}|r={ranking}|d={(domain or '').lower()}"


class ResultCache:
    """The least recently used result goes when it is full; results end after some seconds. ``clock`` tells the time."""

    def __init__(self, size: int = DEFAULTS.cache_size, seconds: float = DEFAULTS.cache_seconds, clock=time.time):
        self.size, self.seconds, self.clock = size, seconds, clock
        self.kept: OrderedDict[str, tuple[Any, float]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: str) -> Any:
        """The result, or None if there is none or it has ended."""
        value, ends = self.kept.get(key, (None, 0.0))
        if key in self.kept and self.clock() <= ends:
            self.kept.move_to_end(key)
            self.hits += 1
            return value
        self.kept.pop(key, None)
        self.misses += 1
        return None

    def put(self, key: str, value: Any, seconds: float | None = None) -> None:
        if key not in self.kept and len(self.kept) >= self.size:
            self.kept.popitem(last=False)
        self.kept[key] = (value, self.clock() + (self.seconds if seconds is None else seconds))
        self.kept.move_to_end(key)

    def clear(self) -> None:
        """Drops all results; the counts of hits and misses go on."""
        self.kept.clear()

    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"size": len(self.kept), "max_size": self.size, "hits": self.hits, "misses": self.misses, "hit_rate_pct": round(100 * self.hits / asked, 2) if asked else 0.0}
