"""Who acts, why, and for whom: ambient facts that entries carry.  Scopes nest; inner facts win, metadata adds up."""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Actor:
    id: str | None = None
    name: str | None = None
    type: str = "Unknown"


UNKNOWN = Actor()


@dataclass(frozen=True)
class AuditScope:
    actor: Actor | None = None
    reason: str | None = None
    correlation_id: str | None = None
    tenant_id: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)


_current: ContextVar[AuditScope | None] = ContextVar("audit_scope", default=None)


def current_scope() -> AuditScope | None:
    return _current.get()


@contextmanager
def audit_scope(actor: Actor | None = None, reason: str | None = None, correlation_id: str | None = None, tenant_id: str | None = None, **metadata: str):
    outer = _current.get() or AuditScope(correlation_id=str(uuid.uuid4()))
    scope = replace(
        outer, actor=actor or outer.actor, reason=reason or outer.reason, correlation_id=correlation_id or outer.correlation_id,
        tenant_id=tenant_id or outer.tenant_id, metadata={**outer.metadata, **metadata},
    )
    token = _current.set(scope)
    try:
        yield scope
    finally:
        _current.reset(token)
