"""Ceilings on what one read may take."""

from __future__ import annotations

from dataclasses import dataclass

from .errors import LimitExceeded


@dataclass(frozen=True)
class Limits:
    """Levels and results of a read, edges that it may look at, and changes that go together. Exceeding one fails the whole call."""

    depth: int = 16
    results: int = 10_000
    edges: int = 100_000
    changes: int = 1_000

    def check(self, **asked: int) -> None:
        for name, n in asked.items():
            if n > getattr(self, name):
                raise LimitExceeded(f"{name}: {n} is more than {getattr(self, name)}")


STRICT = Limits()
