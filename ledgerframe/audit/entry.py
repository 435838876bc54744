"""Audit entries from change sets.

A change set's rows (op, old, new) become one entry each: who, what, when, and a JSON document with the operation, the
key, and the columns as they were and are.  An update in which no captured column changed leaves no entry.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AuditNotSupported
from ..functions.payload import json_value, joined, key_text, object_of, quoted, stored_text
from ..functions.ordinals import uuid7
from ..options import AuditOps, AuditOptions
from .scope import UNKNOWN, Actor, AuditScope, current_scope
from .spec import AuditPlan

ENTRY = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("entity_type", T.StringType(), False), T.StructField("entity_key", T.StringType(), False),
    T.StructField("operation", T.IntegerType(), False), T.StructField("source", T.StringType(), False), T.StructField("actor_id", T.StringType()),
    T.StructField("actor_name", T.StringType()), T.StructField("actor_type", T.StringType()), T.StructField("tenant_id", T.StringType()),
    T.StructField("occurred_at", T.TimestampNTZType()), T.StructField("correlation_id", T.StringType()), T.StructField("changes", T.StringType()),
])

_CODES = {"INSERT": (1, "insert", AuditOps.INSERT), "UPDATE": (2, "update", AuditOps.UPDATE), "DELETE": (3, "delete", AuditOps.DELETE)}


def _at(side: str, path: str) -> Column:
    return F.col(f"`{side}`." + ".".join(f"`{p}`" for p in path.split(".")))


class _Values:
    """Payload forms of one captured column."""

    def __init__(self, path: str, name: str, kind: T.DataType, mask, limit: int):
        self.path, self.name, self.kind, self.mask, self.limit = path, name, kind, mask, limit

    def cuttable(self) -> bool:
        return self.limit > 0 and self.mask is False and isinstance(self.kind, (T.StringType, T.BinaryType))

    def text(self, side: str) -> Column:
        c = _at(side, self.path)
        if callable(self.mask):
            return F.when(c.isNotNull() | F.lit(True), quoted(self.mask(c)))
        if self.mask is not False:
            return F.when(c.isNull(), F.lit("null")).otherwise(quoted(F.lit(self.mask)))
        if self.cuttable():
            return quoted(F.substring(stored_text(c, self.kind), 1, self.limit))
        return json_value(c, self.kind)

    def cut(self, side: str) -> Column:
        if not self.cuttable():
            return F.lit(False)
        return F.coalesce(F.length(stored_text(_at(side, self.path), self.kind)) > self.limit, F.lit(False))

    def changed(self) -> Column:
        return ~_at("old", self.path).eqNullSafe(_at("new", self.path))


def _side(columns: list[_Values], side: str, only_changed: bool) -> Column:
    return object_of([(c.name, c.text(side), c.changed() if only_changed else None) for c in columns])


def payload(plan: AuditPlan, options: AuditOptions, scope: AuditScope | None) -> Column:
    """The entry's JSON document over columns op, old, new."""
    columns = [_Values(*c, options.max_value_length) for c in plan.columns]
    gone = F.col("op") == "DELETE"
    key = object_of([(k, json_value(F.when(gone, _at("old", k)).otherwise(_at("new", k)), plan.model.type_of(k)), None) for k in plan.key])
    insert, delete = F.col("op") == "INSERT", gone
    partial = (F.col("op") == "UPDATE") & F.col("old").isNull()
    update = (F.col("op") == "UPDATE") & F.col("old").isNotNull()
    names = F.concat(F.lit("["), joined([F.when(c.changed(), F.lit(json.dumps(c.name, ensure_ascii=False))) for c in columns]), F.lit("]"))
    any_of = lambda cs: F.greatest(F.lit(False), F.lit(False), *cs)
    cut = (
        F.when(insert | partial, any_of([c.cut("new") for c in columns])).when(delete, any_of([c.cut("old") for c in columns]))
        .otherwise(any_of([c.changed() & (c.cut("old") | c.cut("new")) for c in columns]))
    )
    meta = {}
    if scope is not None:
        meta = ({"reason": scope.reason} if scope.reason else {}) | dict(sorted(scope.metadata.items()))
    op = F.concat(F.lit('"'), F.lower("op"), F.lit('"'))
    return object_of([
        ("op", op, None), ("key", key, None), ("partial", F.lit("true"), partial), ("changed", names, update),
        ("old", F.when(delete, _side(columns, "old", False)).otherwise(_side(columns, "old", True)), update | delete),
        ("new", F.when(update, _side(columns, "new", True)).otherwise(_side(columns, "new", False)), insert | partial | update),
        *([("meta", F.lit(json.dumps(meta, ensure_ascii=False, separators=(",", ":"))), None)] if meta else []),
        ("__truncated", F.lit("true"), cut),
    ])


def any_change(plan: AuditPlan) -> Column:
    columns = [_Values(*c, 0).changed() for c in plan.columns]
    return F.greatest(F.lit(False), F.lit(False), *columns)


def resolve_actor(options: AuditOptions, scope: AuditScope | None) -> Actor:
    actor = (scope.actor if scope else None) or (options.actor() if options.actor else None)
    if actor is None and options.require_actor:
        raise AuditNotSupported("an actor is required and nobody is known to act")
    return actor or UNKNOWN


def resolve_tenant(plan: AuditPlan, options: AuditOptions, scope: AuditScope | None) -> Column:
    """The row's tenant column, else the scope's, else the provider's."""
    outside = (scope.tenant_id if scope else None) or (options.tenant_provider() if options.tenant_provider else None)
    if plan.tenant is None:
        if outside is None and options.require_tenant:
            raise AuditNotSupported("a tenant is required and none is known")
        return F.lit(outside).cast("string")
    kind = plan.model.type_of(plan.tenant)
    own = F.coalesce(stored_text(_at("new", plan.tenant), kind), stored_text(_at("old", plan.tenant), kind))
    return F.coalesce(own, F.lit(outside).cast("string"))


def entries(plan: AuditPlan, changes: DataFrame, source: str, options: AuditOptions, before_images: bool = True, scope: AuditScope | None = None) -> DataFrame:
    """Entries of a change set.  Without before-images updates are told as partial; a merge can't be told at all."""
    scope = scope or current_scope()
    if not before_images:
        if source in ("Bulk.Merge", "Bulk.Synchronize"):
            raise AuditNotSupported("a merge is told apart by what rows were before; it needs before-images")
        changes = changes.withColumn("old", F.when(F.col("op") != "UPDATE", F.col("old")))
    wanted = [name for name, (_, _, flag) in _CODES.items() if flag & plan.spec.operations]
    rows = changes.where(F.col("op").isin(*wanted)).where((F.col("op") != "UPDATE") | F.col("old").isNull() | any_change(plan))
    actor, moment = resolve_actor(options, scope), options.clock()
    gone = F.col("op") == "DELETE"
    key = key_text([(F.when(gone, _at("old", k)).otherwise(_at("new", k)), plan.model.type_of(k)) for k in plan.key])
    code = F.when(F.col("op") == "INSERT", 1).when(F.col("op") == "UPDATE", 2).otherwise(3)
    correlation = (scope.correlation_id if scope else None) or str(uuid.uuid4())
    ids = options.ids(rows) if options.ids else uuid7()
    extra = [F.get_json_object("changes", path).alias(name) for name, path in options.json_columns.items()]
    told = rows.select(
        ids.cast("string").alias("id"), F.lit(plan.entity_type).alias("entity_type"), key.alias("entity_key"), code.cast("int").alias("operation"), F.lit(source).alias("source"),
        F.lit(actor.id).cast("string").alias("actor_id"), F.lit(actor.name).cast("string").alias("actor_name"), F.lit(actor.type).alias("actor_type"),
        resolve_tenant(plan, options, scope).alias("tenant_id"), F.lit(moment).cast("timestamp_ntz").alias("occurred_at"), F.lit(correlation).alias("correlation_id"),
        payload(plan, options, scope).alias("changes"),
    )
    return told.select("*", *extra) if extra else told
