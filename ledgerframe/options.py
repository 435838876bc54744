"""Settings of a session and of single calls."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum, Flag, auto
from typing import Any

from .errors import AuditNotSupported, NotSupported


class CountStrategy(Enum):
    TOTAL_COUNT = "total"
    HAS_NEXT_PROBE = "probe"
    NONE = "none"


class Numbering(Enum):
    ZERO_BASED = 0
    ONE_BASED = 1


class Checks(Flag):
    NONE = 0
    MISSING_INDEX = auto()
    NON_DETERMINISTIC_ORDER = auto()
    DEEP_OFFSET = auto()
    ENTITY_PROJECTION = auto()
    COLLECTION_INCLUDE = auto()
    LARGE_IN_CLAUSE = auto()
    ALL = MISSING_INDEX | NON_DETERMINISTIC_ORDER | DEEP_OFFSET | ENTITY_PROJECTION | COLLECTION_INCLUDE | LARGE_IN_CLAUSE


class OnWarning(Enum):
    IGNORE = "ignore"
    DIAGNOSTIC = "diagnostic"
    RAISE = "raise"


@dataclass(frozen=True)
class QueryOptions:
    default_page_size: int = 20
    max_page_size: int = 100
    numbering: Numbering = Numbering.ONE_BASED
    count: CountStrategy = CountStrategy.TOTAL_COUNT
    max_offset_rows: int = 50_000
    batch_size: int = 1_000
    max_in_values: int = 2_000
    checks: Checks = Checks.NONE
    on_warning: OnWarning = OnWarning.DIAGNOSTIC
    tracking_scopes: bool = True

    def __post_init__(self):
        for name in ("default_page_size", "max_page_size", "max_offset_rows", "batch_size", "max_in_values"):
            if getattr(self, name) < 1:
                raise NotSupported(f"{name} must be at least 1")
        if self.default_page_size > self.max_page_size:
            raise NotSupported("default_page_size is above max_page_size")

    @property
    def advises(self) -> bool:
        return bool(self.checks) and self.on_warning is not OnWarning.IGNORE


class Op(Enum):
    INSERT = "Insert"
    UPDATE = "Update"
    DELETE = "Delete"
    MERGE = "Merge"
    SYNCHRONIZE = "Synchronize"


class OnUnsupported(Enum):
    FALL_BACK = "fall back"
    RAISE = "raise"


@dataclass(frozen=True)
class WriteOptions:
    """Of a session: `threshold` rows make a change batch worth a set-based write; a table of more than
    `narrow_files` files is searched by its match columns first; `declines` may give a reason why a write takes the
    plain path over the whole table, which `on_unsupported` allows or refuses."""

    threshold: int = 100
    max_batch: int = 50_000
    narrow_files: int = 64
    on_unsupported: OnUnsupported = OnUnsupported.FALL_BACK
    declines: Callable[[Any], str | None] | None = None
    validate_constraints: bool = True
    timeout_seconds: float | None = None


@dataclass(frozen=True)
class Call:
    """Of one bulk call.  Merge counts are exact whatever `exact_counts` says: both ways cost the same here."""

    match_on: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    insert_only: tuple[str, ...] = ()
    scope: Any = None
    allow_full_table_delete: bool = False
    include_graph: bool = False
    batch_size: int | None = None
    on_progress: Callable[[Any], None] | None = None
    timeout_seconds: float | None = None
    observers: bool = True
    before_images: bool = True
    savepoint: bool = True
    track: bool = False
    exact_counts: bool = True


class AuditOps(Flag):
    NONE = 0
    INSERT = auto()
    UPDATE = auto()
    DELETE = auto()
    ALL = INSERT | UPDATE | DELETE


class Atomicity(Enum):
    SAME_TRANSACTION = "same"
    BEST_EFFORT = "best effort"


class OnSinkFailure(Enum):
    RAISE = "raise"
    IGNORE = "ignore"


class TrailLayout(Enum):
    """How the trail's files are sorted, which is what its questions prune by."""

    BY_ROW = "entity, then time"
    BY_TENANT = "tenant, then time"
    BY_TIME = "time"


class Naming(Enum):
    PROPERTY = "property"
    COLUMN = "column"


def utc_now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


@dataclass(frozen=True)
class AuditOptions:
    table: str = "audit_entries"
    all_tables: bool = False
    max_value_length: int = 4096
    batch_threshold: int = 100
    mask: str = "***"
    mask_columns: Callable[[str], bool] = lambda name: False
    atomicity: Atomicity = Atomicity.SAME_TRANSACTION
    on_sink_failure: OnSinkFailure = OnSinkFailure.RAISE
    before_images: bool = True
    naming: Naming = Naming.PROPERTY
    column_names: dict[str, dict[str, str]] = field(default_factory=dict)
    tenant_column: str | None = "TenantId"
    tenant_provider: Callable[[], str | None] | None = None
    require_tenant: bool = False
    actor: Callable[[], Any] | None = None
    require_actor: bool = False
    ids: Callable[..., Any] | None = None
    clock: Callable[[], dt.datetime] = utc_now
    external: bool = False
    layout: TrailLayout = TrailLayout.BY_ROW
    json_columns: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if self.external and self.atomicity is Atomicity.SAME_TRANSACTION:
            raise AuditNotSupported("entries that go to another store can't share the transaction")
        if self.require_tenant and not (self.tenant_column or self.tenant_provider):
            raise AuditNotSupported("a tenant is required but nothing gives one")
