"""Bulk writes as pure functions of a target and a source: what the table becomes, and what changed.

Every function returns a ChangeSet whose `next` is the target's next state and whose `changes` has a row
(op, old, new) for each row inserted, updated or deleted, with whole rows as they were and as they are.
Matching is `=`: a null match column matches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConcurrencyConflict, ConstraintViolation, WriteNotSupported
from ..functions.ordinals import with_dense_ordinal
from ..model import TableModel
from ..options import Op
from ..plans.write_plan import WritePlan
from .filtering import Scope

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"


@dataclass(frozen=True)
class BulkResult:
    inserted: int = 0
    updated: int = 0
    deleted: int = 0

    @property
    def total(self) -> int:
        return self.inserted + self.updated + self.deleted


@dataclass
class ChangeSet:
    plan: WritePlan
    next: DataFrame
    changes: DataFrame
    matched: int | None = None  # source rows that found a target, where that is the count
    inserted_rows: DataFrame | None = field(default=None, repr=False)

    @cached_property
    def result(self) -> BulkResult:
        if self.plan.op is Op.UPDATE:
            return BulkResult(updated=self.matched)
        if self.plan.op is Op.DELETE:
            return BulkResult(deleted=self.matched)
        n = {r.op: r.n for r in self.changes.groupBy("op").agg(F.count(F.lit(1)).alias("n")).collect()}
        return BulkResult(n.get(INSERT, 0), n.get(UPDATE, 0), n.get(DELETE, 0))


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def staged(source: DataFrame, plan: WritePlan) -> DataFrame:
    """The source's match and written columns in stored types, prefixed, with a mark."""
    kinds = plan.model.schema
    number = [F.col("src__")] if "src__" in source.columns else []
    return source.select(*[_c(c).cast(kinds[c].dataType).alias(f"s__{c}") for c in plan.staged], F.lit(True).alias("s__hit"), *number)


def _on(plan: WritePlan) -> Column:
    return reduce(lambda a, b: a & b, [_c(c) == _c(f"s__{c}") for c in plan.match])


def _row(model: TableModel, value) -> Column:
    return F.struct(*[value(c).cast(model.schema[c].dataType).alias(c) for c in model.columns])


def _null_row(model: TableModel) -> Column:
    return F.lit(None).cast(model.schema)


def matched_keys(target: DataFrame, keys: DataFrame, plan: WritePlan) -> DataFrame:
    """The target's match values that are among `keys`.  A small `keys` is sent to the target's scan, so that the
    target itself isn't shuffled; what remains is at most as large as `keys`."""
    return target.select(*[_c(c) for c in plan.match]).join(keys, _on(plan), "left_semi").distinct()


def tally(target: DataFrame, s: DataFrame, plan: WritePlan) -> int:
    """Number of source rows that found a target.  Raises where one found none, or two met on one key."""
    keys = [f"s__{c}" for c in plan.match]
    wanted = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    there = matched_keys(target, wanted.select(*keys), plan).withColumn("t__hit", F.lit(True))
    r = wanted.join(there, _on(plan), "left").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("t__hit").isNull(), F.col("n"))).alias("missing"), F.sum(F.when(F.col("t__hit") & (F.col("n") > 1), 1)).alias("twice")
    ).first()
    if r.twice:
        raise ConcurrencyConflict(f"{r.twice} rows of {plan.model.name} are changed by more than one source row")
    if r.missing:
        raise ConcurrencyConflict(f"expected to change {r.n} rows of {plan.model.name}, but {r.missing} aren't there")
    return r.n or 0


def require_single(s: DataFrame, plan: WritePlan) -> None:
    keys = [f"s__{c}" for c in plan.match]
    twice = s.dropna(subset=keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ConcurrencyConflict(f"two source rows meet on one row of {plan.model.name}")


def assigned(plan: WritePlan, have: list[str]) -> list[str]:
    """Columns of new rows that get the next numbers of a sequence."""
    return [c for c, how in plan.model.generated.items() if how == "sequence" and c not in plan.match and c not in have]


def complete(rows: DataFrame, target: DataFrame, plan: WritePlan, order: list[str] | None = None, starts: dict[str, int] | None = None) -> DataFrame:
    """New rows with every column of the table: given ones, defaults for columns that the source lacks (a given
    null stays null), the next numbers of a sequence, and computed expressions.  `starts` says where sequences go
    on; without it they follow the target's largest number, so the target must then be the whole table."""
    model = plan.model
    for c in assigned(plan, rows.columns):
        start = starts[c] if starts else (target.agg(F.max(_c(c)).alias("m")).first().m or 0) + 1
        rows = with_dense_ordinal(rows, c, [_c(o) for o in order] if order else None, start)
    out = []
    for f in model.schema.fields:
        if f.name in rows.columns:
            x = _c(f.name)
        elif f.name in model.generated and model.generated[f.name] != "sequence":
            x = F.expr(model.generated[f.name])
        else:
            x = F.lit(model.defaults.get(f.name))
        out.append(x.cast(f.dataType).alias(f.name))
    return rows.select(*out)


def insert(target: DataFrame, source: DataFrame, plan: WritePlan, order: list[str] | None = None) -> ChangeSet:
    """Every source row is a new row.  `order` says in which order generated numbers are given."""
    rows = source.select(*[_c(c).cast(plan.model.schema[c].dataType).alias(c) for c in plan.write])
    rows = complete(rows, target, plan, order)
    return ChangeSet(plan, target.unionByName(rows), inserted(rows, plan.model), inserted_rows=rows)


def inserted(rows: DataFrame, model: TableModel) -> DataFrame:
    """Changes that add `rows`."""
    return rows.select(F.lit(INSERT).alias("op"), _null_row(model).alias("old"), _row(model, _c).alias("new"))


def update(target: DataFrame, source: DataFrame, plan: WritePlan) -> ChangeSet:
    model, s = plan.model, staged(source, plan)
    n = tally(target, s, plan)
    joined = target.join(s, _on(plan), "left")
    new = lambda c: F.when(F.col("s__hit"), _c(f"s__{c}")).otherwise(_c(c)) if c in plan.update else _c(c)
    following = joined.select(*[new(c).alias(c) for c in model.columns])
    hit = target.join(s, _on(plan))
    changes = hit.select(F.lit(UPDATE).alias("op"), _row(model, _c).alias("old"), _row(model, lambda c: _c(f"s__{c}") if c in plan.update else _c(c)).alias("new"))
    return ChangeSet(plan, following, changes, matched=n)


def delete(target: DataFrame, source: DataFrame, plan: WritePlan) -> ChangeSet:
    model, s = plan.model, staged(source, plan)
    n = tally(target, s, plan)
    changes = target.join(s, _on(plan), "left_semi").select(F.lit(DELETE).alias("op"), _row(model, _c).alias("old"), _null_row(model).alias("new"))
    return ChangeSet(plan, target.join(s, _on(plan), "left_anti"), changes, matched=n)


def scoped(target: DataFrame, model: TableModel, scope: Scope | None) -> DataFrame:
    """`target` with t__in: whether a synchronize may remove the row."""
    return scope.within(target, model, "t__in") if scope is not None else target.withColumn("t__in", F.lit(True))


def merge(target: DataFrame, source: DataFrame, plan: WritePlan, scope: Scope | None = None, small: bool = False) -> ChangeSet:
    """Matched rows are updated, source rows without a match inserted; in a synchronize, rows in scope without a
    source row are deleted.  Rows whose scope is unknown stay.  With nothing to update, matched rows stay.

    One full outer join; or, for a `small` source and where the store assigns numbers, a left join and the source rows
    without a match, in which the planner may send the source to the target's scan and shuffle nothing."""
    model, s = plan.model, staged(source, plan)
    require_single(s, plan)
    t = scoped(target.select(*[_c(c) for c in model.columns], F.lit(True).alias("t__hit")), model, scope)
    gone = F.when(F.col("t__in"), F.lit(DELETE)) if plan.op is Op.SYNCHRONIZE else F.lit(None).cast("string")
    action = F.when(F.col("t__hit") & F.col("s__hit"), F.lit(UPDATE if plan.update else None).cast("string")).when(F.col("s__hit"), F.lit(INSERT)).otherwise(gone)
    sequences = [c for c, how in model.generated.items() if how == "sequence" and c not in plan.match and c not in plan.write]

    def value(c: str) -> Column:
        if c in plan.update:
            return F.when(F.col("s__hit"), _c(f"s__{c}")).otherwise(_c(c))
        if c in plan.staged:
            return F.when(F.col("t__hit"), _c(c)).otherwise(_c(f"s__{c}"))
        if c in model.generated:
            return F.when(F.col("t__hit"), _c(c)) if c in sequences else F.when(F.col("t__hit"), _c(c)).otherwise(F.expr(model.generated[c]))
        return F.when(F.col("t__hit"), _c(c)).otherwise(F.lit(model.defaults.get(c)))

    apart = small or bool(sequences)
    joined = t.join(s, _on(plan), "left" if apart else "full_outer")
    rows = joined.select(action.alias("op"), F.col("t__hit").alias("was"), _row(model, _c).alias("old"), _row(model, value).alias("new"))
    if apart:
        there = matched_keys(target, s.select(*[f"s__{c}" for c in plan.match]), plan)
        fresh = s.join(there, _on(plan), "left_anti").select(*[_c(f"s__{c}").alias(c) for c in plan.staged])
        fresh = complete(fresh, target, plan, list(plan.match) if sequences else None)
        rows = rows.unionAll(fresh.select(F.lit(INSERT).alias("op"), F.lit(None).cast("boolean").alias("was"), _null_row(model).alias("old"), _row(model, _c).alias("new")))
    stay = F.col("op").isNull() | (F.col("op") != DELETE)
    following = rows.where(stay).select("new.*")
    changes = rows.where(F.col("op").isNotNull()).select("op", F.when(F.col("was"), F.col("old")).alias("old"), F.when(F.col("op") != DELETE, F.col("new")).alias("new"))
    return ChangeSet(plan, following, changes)


def check_synchronize(model: TableModel, source: DataFrame, scope: Scope | None, allow_full_table_delete: bool) -> None:
    if scope is None and not allow_full_table_delete:
        raise WriteNotSupported("a synchronize deletes what the source lacks; give a scope or allow_full_table_delete")
    if scope is None and model.filters:
        raise WriteNotSupported(f"{model.name} is read through filters; a synchronize needs a scope so as not to delete rows that they hide")
    if source.isEmpty():
        raise WriteNotSupported("an empty source would delete everything in scope; use a delete")


def before_images(target: DataFrame, source: DataFrame, plan: WritePlan) -> DataFrame:
    """Matched rows as they stood, columns prefixed old_."""
    s = staged(source, plan)
    return target.join(s.select(*[f"s__{c}" for c in plan.match]).distinct(), _on(plan), "left_semi").select(*[_c(c).alias(f"old_{c}") for c in plan.model.columns])


def removed_rows(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("op") == DELETE).select("old.*")


def broken(model: TableModel) -> dict[str, Column]:
    """What a new or changed row may not be: required columns and checks; a check that is unknown holds."""
    tests = {f"{c} is null": F.col(f"`{c}`").isNull() for c in sorted(model.required | set(model.key))}
    return tests | {f"check {n}": ~F.coalesce(F.expr(e), F.lit(True)) for n, e in model.checks.items()}
