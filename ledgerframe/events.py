"""A small publish and subscribe bus for what queries, writes and the audit report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Event:
    source: str  # query, write, audit
    name: str
    facts: dict[str, Any] = field(default_factory=dict)


class EventBus:
    def __init__(self):
        self._handlers: list[tuple[str | None, Callable[[Event], None]]] = []

    def subscribe(self, handler: Callable[[Event], None], source: str | None = None) -> Callable[[], None]:
        """Calls `handler` for each event (of one source); returns what ends that."""
        entry = (source, handler)
        self._handlers.append(entry)
        return lambda: self._handlers.remove(entry) if entry in self._handlers else None

    def publish(self, source: str, name: str, **facts) -> None:
        for wanted, handler in list(self._handlers):
            if wanted in (None, source):
                handler(Event(source, name, facts))
