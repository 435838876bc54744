"""Which tables and columns are audited, and how."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import types as T

from ..errors import AuditNotSupported
from ..model import TableModel
from ..options import AuditOps, AuditOptions, Naming


@dataclass(frozen=True)
class AuditSpec:
    """Of one table.  Excluded columns leave no trace; masked ones show that they changed, not to what.  A mask is a
    text, or a function of the stored value's column."""

    audited: bool | None = True
    operations: AuditOps = AuditOps.ALL
    exclude: frozenset[str] = frozenset()
    mask: dict[str, str | Callable[[Column], Column] | None] = field(default_factory=dict)
    key_from: tuple[str, ...] = ()
    tenant_column: str | None = None
    entity_type: str | None = None
    fold: tuple[str, ...] = ()

    def __post_init__(self):
        if self.audited is False and (self.exclude or self.mask or self.key_from):
            raise AuditNotSupported("a table that isn't audited says nothing about columns")
        if self.audited and self.operations is AuditOps.NONE:
            raise AuditNotSupported("an audited table audits an operation")
        both = sorted(self.exclude & set(self.mask))
        if both:
            raise AuditNotSupported(f"{', '.join(both)} is excluded and masked")


@dataclass(frozen=True)
class AuditPlan:
    """What is captured of a table: (path, name in the payload, type, mask), by payload name."""

    model: TableModel
    spec: AuditSpec
    entity_type: str
    key: tuple[str, ...]
    columns: tuple[tuple[str, str, T.DataType, object], ...]
    tenant: str | None


def audits(model: TableModel, spec: AuditSpec | None, options: AuditOptions) -> bool:
    if model.name == options.table or not model.mapped:
        return False
    if spec is not None and spec.audited is not None:
        return spec.audited
    return options.all_tables and bool(model.key)


def plan_audit(model: TableModel, spec: AuditSpec | None, options: AuditOptions) -> AuditPlan:
    spec = spec or AuditSpec()
    if not (spec.key_from or model.key):
        raise AuditNotSupported(f"{model.name} has no key, so its entries would name no row")
    paths = model.paths
    named = sorted(({*spec.exclude, *spec.mask, *spec.key_from} | ({spec.tenant_column} if spec.tenant_column else set())) - set(paths) - set(model.columns))
    if named:
        raise AuditNotSupported(f"{model.name} has no column {', '.join(named)}")
    names = options.column_names.get(model.name, {}) if options.naming is Naming.COLUMN else {}
    out = []
    for p in paths:
        if p in spec.exclude or p.split(".")[0] in spec.exclude:
            continue
        mask = spec.mask.get(p, options.mask if options.mask_columns(p.split(".")[-1]) else False)
        mask = options.mask if mask is None else mask
        out.append((p, names.get(p, p), model.type_of(p), mask))
    out.sort(key=lambda c: c[1])
    tenant = spec.tenant_column or (options.tenant_column if options.tenant_column in model.columns else None)
    return AuditPlan(model, spec, spec.entity_type or model.name, tuple(spec.key_from or model.key), tuple(out), tenant)
