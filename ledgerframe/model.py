"""What a table means beyond its schema: keys, references, generated values, filters, checks.

Parquet tables carry none of it, so writes and paging take it from here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from .errors import NotSupported


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    references: tuple[str, ...]


@dataclass(frozen=True)
class Converter:
    """How a model value is stored.  Columns hold stored values already; this is for values from outside."""

    to_store: Callable[[Any], Any]
    from_store: Callable[[Any], Any]
    order_preserving: bool = False


@dataclass(frozen=True)
class TableModel:
    """One table.

    key and uniques prove total orders and match rows; `layout` lists the column orders by which data is laid out
    (partitioning, bucketing, sorting), which the advisor treats as indexes; `generated` columns are assigned on
    insert (`sequence`) or computed by an SQL expression; `tokens` are concurrency columns; `filters` are named SQL
    predicates that reads apply; `checks` are named SQL predicates that rows must not fail; `nested` are the branches
    of nested rows that an insert may bring along; `procedures` are the change states (Added, Modified, Deleted) that
    a procedure of the store writes and `json` the columns that are changed inside, both never worth a batch.
    """

    name: str
    schema: T.StructType
    key: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    required: frozenset[str] = frozenset()
    layout: tuple[tuple[str, ...], ...] = ()
    references: tuple[ForeignKey, ...] = ()
    generated: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, Any] = field(default_factory=dict)
    tokens: frozenset[str] = frozenset()
    filters: dict[str, str] = field(default_factory=dict)
    converters: dict[str, Converter] = field(default_factory=dict)
    checks: dict[str, str] = field(default_factory=dict)
    nested: tuple[Any, ...] = ()
    procedures: frozenset[str] = frozenset()
    json: frozenset[str] = frozenset()
    temporal: bool = False
    mapped: bool = True

    def __post_init__(self):
        known = set(self.columns)
        named = [*self.key, *(c for u in self.uniques for c in u), *self.required, *(c for x in self.layout for c in x), *self.generated, *self.defaults, *self.tokens, *self.converters, *(c for r in self.references for c in r.columns)]
        unknown = sorted(set(named) - known - set(self.paths))
        if unknown:
            raise NotSupported(f"table {self.name} has no column {', '.join(unknown)}")

    def __hash__(self):
        return hash(self.name)

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    @property
    def paths(self) -> list[str]:
        """Leaf columns, with those of nested structs as dotted paths."""
        out: list[str] = []

        def walk(schema: T.StructType, before: str) -> None:
            for f in schema.fields:
                if isinstance(f.dataType, T.StructType):
                    walk(f.dataType, f"{before}{f.name}.")
                else:
                    out.append(f"{before}{f.name}")

        walk(self.schema, "")
        return out

    def type_of(self, path: str) -> T.DataType:
        kind: T.DataType = self.schema
        for part in path.split("."):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                raise NotSupported(f"table {self.name} has no column {path}")
            kind = kind[part].dataType
        return kind

    @property
    def never_null(self) -> frozenset[str]:
        return self.required | set(self.key) | {f.name for f in self.schema.fields if not f.nullable}

    @property
    def total_orders(self) -> tuple[tuple[str, ...], ...]:
        """Column sets that name a row."""
        return tuple(x for x in (self.key, *self.uniques) if x)

    def but(self, **changes) -> "TableModel":
        return replace(self, **changes)

    def filtered(self, df: DataFrame, ignore: bool | set[str] = False) -> DataFrame:
        """`df` under the model's filters, all of them, none, or all but the named ones."""
        if ignore is True:
            return df
        for name, predicate in self.filters.items():
            if not ignore or name not in ignore:
                df = df.where(predicate)
        return df


def model_of(df: DataFrame, name: str, **facts) -> TableModel:
    return TableModel(name, df.schema, **facts)


def col(path: str) -> Column:
    """A column by plain or dotted path, whatever characters are in its names."""
    from pyspark.sql import functions as F

    return F.col(".".join(f"`{p}`" for p in path.split(".")))
