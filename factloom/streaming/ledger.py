"""A budget ledger for sources: requests, bytes, cost, deadline and spacing per host, on the driver."""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from contextlib import contextmanager
from dataclasses import dataclass, field


class Exhausted(RuntimeError):
    """The budget does not allow this."""


@dataclass
class Ledger:
    """Limits that all fetches share. Bytes are reserved before a fetch and settled after it, so that they never go over."""

    requests: int
    bytes: int
    cost: float = 0.0
    deadline: float = float("inf")
    host_interval: float = 0.0
    host_parallel: int = 1
    used: dict = field(default_factory=lambda: {"requests": 0, "bytes": 0, "cost": 0.0})
    by_host: dict = field(default_factory=lambda: defaultdict(int))

    def __post_init__(self) -> None:
        self._lock, self._free = threading.Lock(), threading.Condition()
        self._next: dict[str, float] = defaultdict(float)
        self._open: dict[str, int] = defaultdict(int)
        self._reserved, self._cancelled = 0, False

    def cancel(self) -> None:
        self._cancelled = True

    def remaining(self) -> dict:
        with self._lock:
            return {"requests": self.requests - self.used["requests"], "bytes": self.bytes - self.used["bytes"] - self._reserved, "cost": self.cost - self.used["cost"]}

    @contextmanager
    def fetch(self, host: str, most_bytes: int, cost: float = 0.0):
        """Reserve for one request; the block gives the bytes that came through settle()."""
        with self._lock:
            if self._cancelled or time.monotonic() >= self.deadline:
                raise Exhausted("deadline or cancelled")
            if self.used["requests"] >= self.requests or self.used["bytes"] + self._reserved + most_bytes > self.bytes or self.used["cost"] + cost > self.cost:
                raise Exhausted("budget exhausted")
            self.used["requests"] += 1
            self.used["cost"] += cost
            self.by_host[host] += 1
            self._reserved += most_bytes
        came = {"n": most_bytes}
        try:
            with self._free:
                self._free.wait_for(lambda: self._open[host] < self.host_parallel)
                self._open[host] += 1
                wait = self._next[host] - time.monotonic()
                self._next[host] = max(time.monotonic(), self._next[host]) + self.host_interval
            if wait > 0:
                time.sleep(wait)
            yield lambda n: came.update(n=n)
        finally:
            with self._free:
                self._open[host] -= 1
                self._free.notify_all()
            with self._lock:
                self._reserved -= most_bytes
                self.used["bytes"] += came["n"]
