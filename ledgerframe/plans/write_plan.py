"""Which columns a bulk write matches on, writes and assigns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..errors import WriteNotSupported
from ..model import TableModel
from ..options import Call, Op


@dataclass(frozen=True)
class WritePlan:
    """match: columns that find a row; write: columns taken from the source on insert; update: those also taken on
    a match; generated: columns that the store assigns to new rows."""

    model: TableModel
    op: Op
    match: tuple[str, ...]
    write: tuple[str, ...]
    update: tuple[str, ...]
    generated: tuple[str, ...]

    @property
    def staged(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.match, *(self.write if self.op is not Op.DELETE else ()))))


def check_model(model: TableModel, op: Op) -> None:
    if not model.mapped:
        raise WriteNotSupported(f"{model.name} isn't a table of this session")
    if model.temporal:
        raise WriteNotSupported(f"{model.name} keeps its own history, which a bulk write would bypass")
    if model.tokens and op is not Op.INSERT:
        raise WriteNotSupported(f"{model.name} has a concurrency token, which a bulk {op.value.lower()} wouldn't check")


def plan_write(model: TableModel, op: Op, source: DataFrame, call: Call = Call()) -> WritePlan:
    check_model(model, op)
    if call.scope is not None and op is not Op.SYNCHRONIZE:
        raise WriteNotSupported("only a synchronize has a scope")
    if call.include and call.exclude:
        raise WriteNotSupported("columns are included or excluded, not both")
    if call.insert_only and op not in (Op.MERGE, Op.SYNCHRONIZE):
        raise WriteNotSupported("only a merge or synchronize has insert-only columns")
    if call.match_on and op is Op.INSERT:
        raise WriteNotSupported("an insert matches nothing")
    if call.include_graph and op is not Op.INSERT:
        raise WriteNotSupported("only an insert brings nested rows along")
    if call.include_graph and (call.include or call.exclude or call.scope is not None or call.insert_only or call.match_on):
        raise WriteNotSupported("a graph is inserted with all its columns")
    nested = [c for c in call.match_on if "." in c]
    if nested:
        raise WriteNotSupported(f"rows are matched by whole columns, not by {', '.join(nested)}")
    known = set(model.columns)
    unknown = sorted({*call.include, *call.exclude, *call.insert_only, *call.match_on} - known)
    if unknown:
        raise WriteNotSupported(f"{model.name} has no column {', '.join(unknown)}")
    match = () if op is Op.INSERT else tuple(call.match_on or model.key)
    if op is not Op.INSERT and not match:
        raise WriteNotSupported(f"{model.name} has no key to match rows by")
    given = [c for c in model.columns if c in source.columns]
    missing = [c for c in match if c not in given]
    if missing:
        raise WriteNotSupported(f"the source lacks {', '.join(missing)}")
    generated = tuple(c for c in model.columns if c in model.generated and c not in match)
    free = [c for c in given if c not in generated]
    refused = [c for c in call.include if c in model.generated]
    if refused:
        raise WriteNotSupported(f"{', '.join(refused)} is assigned by the store")
    dropped = [c for c in call.exclude if c in match or (op is Op.INSERT and c in model.key and c not in generated)]
    if dropped:
        raise WriteNotSupported(f"{', '.join(dropped)} finds the row and can't be left out")
    if call.include:
        free = [c for c in free if c in call.include or c in match]
    free = [c for c in free if c not in call.exclude]
    keyed = set(match) | (set(model.key) if op in (Op.UPDATE, Op.MERGE, Op.SYNCHRONIZE) else set())
    update = tuple(c for c in free if c not in keyed and c not in call.insert_only)
    if op is Op.UPDATE and not update:
        raise WriteNotSupported("the update has nothing to write")
    return WritePlan(model, op, match, tuple(free), update if op is not Op.INSERT else (), generated)
