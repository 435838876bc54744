"""Whether reads remember what they returned, so that changes can be saved later.

Scopes nest; the innermost that is still open wins, in whatever order they are closed.
"""

from __future__ import annotations

from contextvars import ContextVar
from enum import Enum


class Tracking(Enum):
    TRACKING = "tracking"
    NO_TRACKING = "no tracking"
    NO_TRACKING_WITH_IDENTITY = "no tracking with identity resolution"


_stack: ContextVar[tuple["TrackingScope", ...]] = ContextVar("tracking", default=())


class TrackingScope:
    def __init__(self, behaviour: Tracking, owner: object | None = None):
        self.behaviour, self.owner, self.open = behaviour, owner, True
        _stack.set((*_stack.get(), self))

    def close(self) -> None:
        self.open = False
        stack = _stack.get()
        while stack and not stack[-1].open:
            stack = stack[:-1]
        _stack.set(stack)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


def begin(behaviour: Tracking) -> TrackingScope:
    return TrackingScope(behaviour)


def tracking() -> TrackingScope:
    return begin(Tracking.TRACKING)


def no_tracking() -> TrackingScope:
    return begin(Tracking.NO_TRACKING)


def no_tracking_with_identity() -> TrackingScope:
    return begin(Tracking.NO_TRACKING_WITH_IDENTITY)


def current(default: Tracking = Tracking.TRACKING, owner: object | None = None) -> Tracking:
    for scope in reversed(_stack.get()):
        if scope.open and scope.owner in (None, owner):
            return scope.behaviour
    return default
