"""Unique columns and references of what a write leaves, checked against the table as it will be.

Each check reads the constrained columns alone and keeps only values that the write brings or takes away, so what is
compared is as large as the change.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConstraintViolation
from ..model import ForeignKey, TableModel
from ..options import Op
from ..plans.write_plan import WritePlan
from .changes import DELETE, UPDATE, _c
from .marking import FILE, ROW

Reader = Callable[[TableModel], DataFrame]


def _among(rows: DataFrame, names: list[str], wanted: DataFrame) -> DataFrame:
    """Rows whose `names` are among those of `wanted`, matched in order."""
    w = wanted.select(*[_c(c).alias(f"w__{i}") for i, c in enumerate(wanted.columns)]).distinct()
    on = reduce(lambda a, b: a & b, [_c(c) == F.col(f"w__{i}") for i, c in enumerate(names)])
    return rows.join(w, on, "left_semi")


def _without(rows: DataFrame, names: list[str], unwanted: DataFrame) -> DataFrame:
    w = unwanted.select(*[_c(c).alias(f"w__{i}") for i, c in enumerate(unwanted.columns)]).distinct()
    on = reduce(lambda a, b: a & b, [_c(c) == F.col(f"w__{i}") for i, c in enumerate(names)])
    return rows.join(w, on, "left_anti")


def _left(stored: DataFrame, marked: DataFrame | None) -> DataFrame:
    """Stored rows (located) that the write neither changes nor removes."""
    if marked is None:
        return stored.drop(FILE, ROW)
    out = marked.where(F.col("op").isNotNull()).select(FILE, ROW)
    return _without(stored, [FILE, ROW], out).drop(FILE, ROW)


def _new(marked: DataFrame | None, fresh: DataFrame | None, names: list[str]) -> DataFrame | None:
    parts = []
    if marked is not None:
        parts.append(marked.where(F.col("op") == UPDATE).select(*[F.col(f"new.`{c}`").alias(c) for c in names]))
    if fresh is not None:
        parts.append(fresh.select(*[_c(c) for c in names]))
    return reduce(DataFrame.unionAll, parts) if parts else None


def check_uniques(plan: WritePlan, stored: DataFrame, marked: DataFrame | None, fresh: DataFrame | None) -> None:
    """`stored` is the whole table, located."""
    model = plan.model
    for unique in model.total_orders:
        names = list(unique)
        moved = bool(set(unique) & set(plan.update)) and plan.op is not Op.INSERT
        if fresh is None and not moved:
            continue
        if not moved and plan.match and set(unique) == set(plan.match):
            continue  # a new row is one that met none, and twice the same was refused
        if all(plan.model.generated.get(c) == "sequence" and c not in plan.match and c not in plan.write for c in unique):
            continue  # numbers of a sequence are new
        mine = _new(marked if moved else None, fresh, names).dropna()
        there = _among(stored.select(*[_c(c) for c in names], FILE, ROW), names, mine)
        rest = _left(there, marked)
        if marked is not None and not moved:  # unchanged values of changed rows
            rest = rest.unionAll(_among(_new(marked, None, names), names, mine))
        twice = rest.unionAll(mine).groupBy(*[_c(c) for c in names]).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
        if twice:
            raise ConstraintViolation(f"{model.name}: {', '.join(unique)} must be unique")


def check_references(plan: WritePlan, read: Reader, stored: DataFrame, marked: DataFrame | None, fresh: DataFrame | None, known: dict[str, TableModel]) -> None:
    """New and changed rows refer to rows that are there."""
    model = plan.model
    for ref in model.references:
        names, keys = list(ref.columns), list(ref.references)
        moved = bool(set(names) & set(plan.update)) and plan.op is not Op.INSERT
        if ref.table not in known or plan.op is Op.DELETE or (fresh is None and not moved):
            continue
        wanted = _new(marked if moved else None, fresh, names).dropna().distinct()
        if ref.table == model.name:
            there = _left(_among(stored.select(*[_c(c) for c in keys], FILE, ROW), keys, wanted), marked)
            there = there.unionAll(_among(_new(marked, fresh, keys), keys, wanted))
        else:
            there = _among(read(known[ref.table]).select(*[_c(c) for c in keys]), keys, wanted)
        if _without(wanted, names, there).limit(1).count():
            raise ConstraintViolation(f"{model.name}: {', '.join(names)} refers to no row of {ref.table}")


def referring(model: TableModel, plan: WritePlan, known: dict[str, TableModel]) -> list[tuple[TableModel, ForeignKey]]:
    """Tables whose rows may lose what they refer to by this write."""
    found = [(m, r) for m in known.values() for r in m.references if r.table == model.name]
    removes = plan.op in (Op.DELETE, Op.SYNCHRONIZE)
    return [(m, r) for m, r in found if removes or (plan.op is not Op.INSERT and set(r.references) & set(plan.update))]


def check_referring(plan: WritePlan, read: Reader, stored: DataFrame, marked: DataFrame, fresh: DataFrame | None, children: list[tuple[TableModel, ForeignKey]]) -> None:
    """No row refers to a row that is gone or has another key now.  `marked` holds rows as they were."""
    model = plan.model
    for child, ref in children:
        keys, names = list(ref.references), list(ref.columns)
        moved = bool(set(keys) & set(plan.update))
        gone = marked.where(F.col("op") == DELETE if not moved else F.col("op").isNotNull()).select(*[F.col(f"old.`{c}`").alias(c) for c in keys]).dropna().distinct()
        still = _left(_among(stored.select(*[_c(c) for c in keys], FILE, ROW), keys, gone), marked).unionAll(_among(_new(marked, fresh, keys), keys, gone))
        gone = _without(gone, keys, still)
        if child.name == model.name:
            rows = _left(_among(stored.select(*[_c(c) for c in names], FILE, ROW), names, gone), marked).unionAll(_among(_new(marked, fresh, names), names, gone))
        else:
            rows = _among(read(child).select(*[_c(c) for c in names]), names, gone)
        if rows.limit(1).count():
            raise ConstraintViolation(f"{child.name}: {', '.join(names)} refers to rows of {model.name} that would be gone")
