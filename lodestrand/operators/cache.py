"""A driver-side cache for results and scores, bounded in size and age, and locks by key."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable, Iterator
from contextlib import contextmanager
from typing import Any


class LruCache:
    """Keeps the most recently used entries; an entry older than its time to live counts as absent."""

    def __init__(self, max_size: int, ttl: float | None = None, clock: Callable[[], float] = time.monotonic):
        if max_size < 1:
            raise ValueError("max_size must be at least 1")
        self.max_size, self.ttl, self.clock = max_size, ttl, clock
        self._held: OrderedDict[Hashable, tuple[Any, float | None]] = OrderedDict()

    def get(self, key: Hashable, default: Any = None) -> Any:
        if key not in self._held:
            return default
        value, until = self._held[key]
        if until is not None and self.clock() >= until:
            del self._held[key]
            return default
        self._held.move_to_end(key)
        return value

    def set(self, key: Hashable, value: Any, ttl: float | None = None) -> None:
        life = self.ttl if ttl is None else ttl
        self._held[key] = (value, None if life is None else self.clock() + life)
        self._held.move_to_end(key)
        while len(self._held) > self.max_size:
            self._held.popitem(last=False)

    def delete(self, key: Hashable) -> bool:
        return self._held.pop(key, None) is not None

    def get_or_compute(self, key: Hashable, compute: Callable[[], Any]) -> Any:
        missing = object()
        value = self.get(key, missing)
        if value is missing:
            value = compute()
            self.set(key, value)
        return value

    def clear(self) -> None:
        """What a files-updated event does."""
        self._held.clear()

    def __len__(self) -> int:
        return len(self._held)


class KeyedLocks:
    """One lock a key: work of one project runs in turn, work of different projects at once. Locks that nobody waits for are dropped."""

    def __init__(self) -> None:
        self._guard = threading.Lock()
        self._locks: dict[Hashable, list] = {}

    @contextmanager
    def holding(self, key: Hashable) -> Iterator[None]:
        with self._guard:
            held = self._locks.setdefault(key, [threading.Lock(), 0])
            held[1] += 1
        try:
            with held[0]:
                yield
        finally:
            with self._guard:
                held[1] -= 1
                if not held[1]:
                    del self._locks[key]

    def __len__(self) -> int:
        return len(self._locks)
