"""Counters, gauges and histograms, as Prometheus text. Invalid input is ignored."""

from __future__ import annotations

import logging
import math
import re
import threading
from collections.abc import Sequence

log = logging.getLogger("lexspark")
_NAME = re.compile(r"[A-Za-z0-9_:]+")
BOUNDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0)
MOST_COUNT, MOST_GAUGE = (1 << 64) - 1, (1 << 63) - 1


class Metrics:
    def __init__(self):
        self._lock = threading.Lock()
        self.counters: dict[str, int] = {}
        self.gauges: dict[str, int] = {}
        self.histograms: dict[str, dict] = {}

    @staticmethod
    def _valid(name: str) -> bool:
        return bool(_NAME.fullmatch(name))

    def increment(self, name: str, amount: int = 1) -> None:
        if self._valid(name) and amount >= 0:
            with self._lock:
                self.counters[name] = min(MOST_COUNT, self.counters.get(name, 0) + amount)

    def set_gauge(self, name: str, value: int) -> None:
        if self._valid(name):
            with self._lock:
                self.gauges[name] = max(-MOST_GAUGE - 1, min(MOST_GAUGE, value))

    def add_gauge(self, name: str, amount: int) -> None:
        self.set_gauge(name, self.gauges.get(name, 0) + amount)

    def observe(self, name: str, value: float, bounds: Sequence[float] = BOUNDS) -> None:
        """A histogram keeps the bounds of its first observation."""
        bounds = tuple(bounds)
        if not self._valid(name) or not math.isfinite(value) or any(a >= b for a, b in zip(bounds, bounds[1:])):
            return
        with self._lock:
            h = self.histograms.setdefault(name, {"bounds": bounds, "buckets": [0] * len(bounds), "count": 0, "sum": 0.0})
            if h["bounds"] != bounds:
                return
            h["buckets"] = [n + (value <= b) for n, b in zip(h["buckets"], bounds)]
            h["count"] += 1
            h["sum"] += value

    def prometheus(self) -> str:
        with self._lock:
            lines = [f"{n} {v}" for values in (self.counters, self.gauges) for n, v in sorted(values.items())]
            for n, h in sorted(self.histograms.items()):
                lines += [f'{n}_bucket{{le="{b:.17g}"}} {c}' for b, c in zip(h["bounds"], h["buckets"])]
                lines += [f'{n}_bucket{{le="+Inf"}} {h["count"]}', f"{n}_sum {h['sum']:.17g}", f"{n}_count {h['count']}"]
        return "".join(line + "\n" for line in lines)
