"""Counters and times of what a table's writer does; a process reads them, or hands them to whatever collects its numbers."""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager


class Metrics:
    """Names are `<what>_total`, `<what>_seconds` and `<what>_rows`. Safe for threads."""

    def __init__(self) -> None:
        self._values: Counter = Counter()
        self._lock = threading.Lock()

    def add(self, name: str, n: float = 1) -> None:
        with self._lock:
            self._values[name] += n

    @contextmanager
    def timed(self, what: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.add(f"{what}_total")
            self.add(f"{what}_seconds", time.perf_counter() - began)

    def snapshot(self) -> dict[str, float]:
        with self._lock:
            return dict(self._values)

    def text(self, **labels: str) -> str:
        """One line for each value, in the exposition format that scrapers of metrics read."""
        inside = ",".join(f'{k}="{v}"' for k, v in sorted(labels.items()))
        return "".join(f"tessera_{name}{{{inside}}} {value:g}\n" for name, value in sorted(self.snapshot().items()))
