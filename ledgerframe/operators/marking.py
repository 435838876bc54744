"""The one join of a durable write: which rows a source touches, where they stand, and what they become.

`marked` has a row for each pair of a target row and a source row that meet (and for rows that a synchronize removes):
op (INSERT never; null where a match changes nothing), the file and the row's number in it, the source row's number,
the match values, and the whole row as it was and as it becomes.  It is written once; counts, conflicts, the files to
rewrite, the next state and the changes all follow from it, and it is as large as the change, not as the table.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConcurrencyConflict, ConstraintViolation
from ..options import Op
from ..plans.write_plan import WritePlan
from .changes import DELETE, UPDATE, BulkResult, _c, _null_row, _on, _row, broken, inserted, scoped, staged
from .filtering import Scope

FILE, ROW, SRC = "file__", "row__", "src__"


def located(table: DataFrame) -> DataFrame:
    """A table's rows with where they stand."""
    return table.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def mark(target: DataFrame, source: DataFrame, plan: WritePlan, scope: Scope | None, want_old: bool) -> DataFrame:
    """`target` has FILE and ROW, `source` SRC.  Without `want_old` rows as they were are left out, so that a delete
    reads the match columns alone."""
    model = plan.model
    removes = plan.op is Op.SYNCHRONIZE
    hit = F.col("s__hit")
    if removes:
        joined = scoped(target, model, scope).join(staged(source, plan), _on(plan), "left").where(hit.isNotNull() | F.col("t__in"))
    else:
        joined = target.join(staged(source, plan), _on(plan))
    if plan.op is Op.DELETE:
        op = F.lit(DELETE)
    else:
        op = F.when(hit, F.lit(UPDATE if plan.update else None).cast("string")).otherwise(F.lit(DELETE))
    new = _row(model, lambda c: _c(f"s__{c}") if c in plan.update else _c(c))
    return joined.select(
        op.alias("op"), FILE, ROW, SRC, *[_c(c).alias(f"m__{i}") for i, c in enumerate(plan.match)],
        (_row(model, _c) if want_old else _null_row(model)).alias("old"), F.when(op == UPDATE, new).otherwise(_null_row(model)).alias("new"),
    )


def unmatched(source: DataFrame, marked: DataFrame, plan: WritePlan) -> DataFrame:
    """Source rows that met no target row, with the columns that an insert takes."""
    met = marked.where(F.col(SRC).isNotNull()).select(F.col(SRC).alias("met__"))
    kinds = plan.model.schema
    return source.join(met, F.col(SRC) == F.col("met__"), "left_anti").select(*[_c(c).cast(kinds[c].dataType).alias(c) for c in plan.staged])


@dataclass(frozen=True)
class Facts:
    """What a write did, from one action over what it marked."""

    source: int
    met: int  # source rows that met a target row
    twice: int  # match values that several source rows met
    doubles: int  # match values that several unmatched source rows share
    files: dict[str, dict[str | None, int]]  # rows by file and op
    broken: dict[str, int]
    highest: dict[str, int | None]  # of generated numbers among new rows

    def count(self, op: str) -> int:
        return sum(n.get(op, 0) for n in self.files.values())

    def result(self, plan: WritePlan) -> BulkResult:
        """Counts of source rows for update and delete, of table rows otherwise."""
        if plan.op is Op.UPDATE:
            return BulkResult(updated=self.met)
        if plan.op is Op.DELETE:
            return BulkResult(deleted=self.met)
        return BulkResult(self.source - self.met, self.count(UPDATE), self.count(DELETE))

    def require(self, plan: WritePlan) -> None:
        name = plan.model.name
        if self.twice or self.doubles:
            raise ConcurrencyConflict(f"{self.twice + self.doubles} rows of {name} are changed by more than one source row")
        if plan.op in (Op.UPDATE, Op.DELETE) and self.met < self.source:
            raise ConcurrencyConflict(f"expected to change {self.source} rows of {name}, but {self.source - self.met} aren't there")
        if self.broken:
            raise ConstraintViolation(f"{name}: {'; '.join(f'{k} ({n} rows)' for k, n in self.broken.items())}")


def facts(plan: WritePlan, source: DataFrame | None, marked: DataFrame | None, fresh: DataFrame | None, checked: bool) -> Facts:
    """One collect: a row for each kind of count, and one for each file and op."""
    model, parts = plan.model, []
    none = F.lit(None).cast("string")

    def part(df: DataFrame, kind: str, name: Column, op: Column, n: Column, m: Column = F.lit(0)) -> None:
        parts.append(df.select(F.lit(kind).alias("kind"), name.alias("name"), op.alias("op"), n.cast("bigint").alias("n"), m.cast("bigint").alias("m")))

    keys = [f"m__{i}" for i in range(len(plan.match))]
    if source is not None:
        part(source.agg(F.count(F.lit(1)).alias("n")), "source", none, none, F.col("n"))
    if marked is not None:
        met = marked.where(F.col(SRC).isNotNull()).groupBy(*keys).agg(F.min(SRC).alias("a"), F.max(SRC).alias("b"))
        met = met.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("a") != F.col("b")).cast("bigint")).alias("twice"))
        part(met, "met", none, none, F.col("n"), F.col("twice"))
        part(marked.groupBy(FILE, "op").agg(F.count(F.lit(1)).alias("n")), "file", F.col(FILE), F.col("op"), F.col("n"))
    if fresh is not None and plan.match:
        again = fresh.select(*[_c(c) for c in plan.match]).dropna().groupBy(*[_c(c) for c in plan.match]).agg(F.count(F.lit(1)).alias("n"))
        part(again.where("n > 1").agg(F.count(F.lit(1)).alias("n")), "doubles", none, none, F.col("n"))
    tests = broken(model) if checked else {}
    numbers = [c for c, how in model.generated.items() if how == "sequence"]
    if fresh is not None and marked is None:  # an insert: what was written is all there is to count
        part(fresh.agg(F.count(F.lit(1)).alias("n")), "source", none, none, F.col("n"))
    rows = [df for df in (fresh, marked.where(F.col("op") == UPDATE).select("new.*") if marked is not None and plan.op is not Op.DELETE else None) if df is not None]
    if tests and rows:
        new = reduce(DataFrame.unionByName, rows)
        counts = new.agg(*[F.count(F.when(t, 1)).alias(f"t{i}") for i, t in enumerate(tests.values())])
        wide = counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.col(f"t{i}").alias("n")) for i, name in enumerate(tests)])).alias("x"))
        part(wide, "broken", F.col("x.name"), none, F.col("x.n"))
    if numbers and fresh is not None:
        top = fresh.agg(*[F.max(_c(c)).alias(f"t{i}") for i, c in enumerate(numbers)])
        wide = top.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"t{i}").cast("bigint").alias("n")) for i, c in enumerate(numbers)])).alias("x"))
        part(wide, "highest", F.col("x.name"), none, F.col("x.n"))
    found = reduce(DataFrame.unionAll, parts).collect()  # a row for each touched file and op, and a few more
    one = lambda kind: sum(r.n or 0 for r in found if r.kind == kind)
    files: dict[str, dict[str | None, int]] = {}
    for r in found:
        if r.kind == "file":
            files.setdefault(r.name, {})[r.op] = r.n
    return Facts(
        one("source"), one("met"), sum(r.m or 0 for r in found if r.kind == "met"), one("doubles"), files,
        {r.name: r.n for r in found if r.kind == "broken" and r.n}, {r.name: r.n for r in found if r.kind == "highest"},
    )


def changed(marked: DataFrame | None, fresh: DataFrame | None, plan: WritePlan) -> DataFrame:
    """(op, old, new) of every row inserted, updated or deleted."""
    parts = []
    if marked is not None:
        parts.append(marked.where(F.col("op").isNotNull()).select("op", "old", "new"))
    if fresh is not None:
        parts.append(inserted(fresh, plan.model))
    return reduce(DataFrame.unionAll, parts)


def remaining(located_rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Located rows that are neither changed nor removed."""
    out = marked.where(F.col("op").isNotNull()).select(F.col(FILE).alias("f__"), F.col(ROW).alias("r__"))
    return located_rows.join(out, (F.col(FILE) == F.col("f__")) & (F.col(ROW) == F.col("r__")), "left_anti").drop(FILE, ROW)
