"""A log of phases: one line for each that ends, and its total seconds by name."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterator
from contextlib import contextmanager


class PerfLog:
    def __init__(self, enabled: bool = False, path: str | None = None) -> None:
        self.enabled, self.path = enabled or bool(path), path
        self.buckets: dict[str, float] = {}
        self.started = time.time()
        if path:
            open(path, "w").close()

    def event(self, what: str, /, **facts: object) -> None:
        if not self.enabled:
            return
        line = f"[perf] t={time.time() - self.started:.3f}s {what}" + "".join(f" {k}={v}" for k, v in facts.items()) + "\n"
        if self.path:
            with open(self.path, "a") as out:
                out.write(line)
        else:
            sys.stderr.write(line)

    def record(self, name: str, seconds: float) -> None:
        self.buckets[name] = self.buckets.get(name, 0.0) + seconds

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.time()
        try:
            yield
        finally:
            self.record(name, time.time() - began)
            self.event(name, elapsed=f"{time.time() - began:.3f}s")

    def write_buckets(self) -> None:
        for name, seconds in self.buckets.items():
            self.event(f"bucket.{name}", total=f"{seconds:.3f}s")
