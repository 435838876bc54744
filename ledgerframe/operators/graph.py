"""Related tables written together: order of tables, depth in self-references, keys handed down."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import WriteNotSupported
from ..functions.ordinals import materialized
from ..model import TableModel


def table_order(models: list[TableModel]) -> list[TableModel]:
    """Referenced tables before those that refer to them; references of a table to itself don't count."""
    by_name = {m.name: m for m in models}
    waits = {m.name: {r.table for r in m.references if r.table in by_name and r.table != m.name} for m in models}
    out: list[TableModel] = []
    while waits:
        ready = [n for n in by_name if n in waits and not waits[n]]
        if not ready:
            raise WriteNotSupported(f"tables refer to each other in a circle: {', '.join(sorted(waits))}")
        for n in ready:
            out.append(by_name[n])
            del waits[n]
        for rest in waits.values():
            rest.difference_update(ready)
    return out


def with_depth(rows: DataFrame, key: str, parent: str, column: str = "depth", most: int = 1_000) -> DataFrame:
    """Rows with the length of their parent chain inside the set; rows of a circle get 0, so every row is written.

    A round settles a level: parents found so far are joined with rows that wait for them, and each round is written
    to the shared folder.  Rounds are as many as the deepest chain is long.
    """
    waiting = materialized(rows, "tree")
    inside = waiting.select(F.col(key).alias("k__")).distinct()
    roots = waiting.join(inside, F.col(parent) == F.col("k__"), "left_anti").withColumn(column, F.lit(0))
    level, out = materialized(roots, "level"), []
    for depth in range(1, most + 1):
        out.append(level)
        above = level.select(F.col(key).alias("k__")).distinct()
        nxt = materialized(waiting.join(above, (F.col(parent) == F.col("k__")), "left_semi").withColumn(column, F.lit(depth)), "level")
        if nxt.isEmpty():
            break
        level = nxt
    else:
        raise WriteNotSupported(f"parent chains of {key} are longer than {most}")
    found = out[0]
    for x in out[1:]:
        found = found.unionAll(x)
    circle = waiting.join(found.select(F.col(key).alias("k__")), F.col(key) == F.col("k__"), "left_anti").withColumn(column, F.lit(0))
    return found.unionAll(circle)


def with_parent_keys(children: DataFrame, parents: DataFrame, temp: str, parent_temp: str, parent_key: str, column: str) -> DataFrame:
    """Children whose `column` is the parent's assigned key, found by a temporary number that both carry."""
    keys = parents.select(F.col(f"`{parent_temp}`").alias("p__"), F.col(f"`{parent_key}`").alias("v__"))
    kind = children.schema[column].dataType if column in children.columns else parents.schema[parent_key].dataType
    joined = children.join(keys, F.col(f"`{temp}`") == F.col("p__"), "left")
    if column in children.columns:
        return joined.withColumn(column, F.coalesce(F.col("v__"), F.col(f"`{column}`")).cast(kind)).drop("p__", "v__")
    return joined.withColumnRenamed("v__", column).drop("p__")


@dataclass(frozen=True)
class Branch:
    """A nested array column that holds rows of another table: column, model, and the child column for the parent's key."""

    column: str
    model: TableModel
    child_key: str
    parent_key: str
    branches: tuple["Branch", ...] = ()


@dataclass(frozen=True)
class SelfReference:
    """Rows of one table that refer to each other: their own numbers, the parent's number, and the column that takes
    the parent's assigned key."""

    number: str
    parent: str
    column: str


@dataclass(frozen=True)
class Link:
    """Where children get their key: the parent's table, its key column, the child's column, and the children's
    column that numbers the parent."""

    parent: str
    parent_key: str
    child_key: str
    number: str


@dataclass(frozen=True)
class Level:
    """Rows of one table in a graph, and what links them to rows above.  Every row has a number, PLACE."""

    rows: DataFrame
    links: tuple[Link, ...] = ()

    def with_rows(self, rows: DataFrame) -> "Level":
        return Level(rows, self.links)


PLACE = "place__"


def unfold(parents: DataFrame, model: TableModel, branches: tuple[Branch, ...], at: str = "") -> dict[str, Level]:
    """Rows by table of nested parents; rows of one table from several places are put together."""
    if PLACE not in parents.columns:
        parents = materialized(parents.withColumn(PLACE, F.concat(F.lit(f"{at}:"), F.monotonically_increasing_id())), "graph")
    found = {model.name: Level(parents.drop(*[b.column for b in branches]))}
    for b in branches:
        here = f"{at}/{b.column}"
        number = f"of{here}"
        child = parents.select(F.col(PLACE).alias(number), F.explode(b.column).alias("c__")).select(F.col(f"`{number}`"), "c__.*")
        below = unfold(child, b.model, b.branches, here)
        below[b.model.name] = Level(below[b.model.name].rows, (*below[b.model.name].links, Link(model.name, b.parent_key, b.child_key, number)))
        for name, level in below.items():
            if name in found:
                level = Level(found[name].rows.unionByName(level.rows, allowMissingColumns=True), found[name].links + level.links)
            found[name] = level
    return found


def keyed(children: DataFrame, parents: DataFrame, link: Link) -> DataFrame:
    """Children with their parents' keys."""
    return with_parent_keys(children, parents, link.number, PLACE, link.parent_key, link.child_key).drop(link.number)
