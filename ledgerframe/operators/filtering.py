"""Composable filters.  A filter that isn't active returns the very DataFrame it was given."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryNotSupported, WriteNotSupported
from ..model import TableModel, col

Predicate = Column | Callable[[], Column]


def where_if(df: DataFrame, condition: bool, predicate: Predicate) -> DataFrame:
    return df.where(predicate() if callable(predicate) and not isinstance(predicate, Column) else predicate) if condition else df


def where_if_not_null(df: DataFrame, value: Any, predicate: Callable[[Any], Column]) -> DataFrame:
    return df if value is None else df.where(predicate(value))


def where_in(df: DataFrame, column: str, values: Iterable[Any], most: int = 2_000, advise: Callable[[int], None] | None = None) -> DataFrame:
    """Rows whose column is among `values`; none for an empty list.  Above `most` values they are joined as a table,
    so the plan stays small; the planner may broadcast it by its size."""
    distinct = list(dict.fromkeys(v for v in values if v is not None))
    if not distinct:
        return df.where(F.lit(False))
    if advise is not None and len(distinct) > most:
        advise(len(distinct))
    if len(distinct) <= most:
        return df.where(col(column).isin(distinct))
    kind = df.select(col(column).alias("v")).schema["v"].dataType
    wanted = df.sparkSession.createDataFrame([(v,) for v in distinct], T.StructType([T.StructField("wanted__", kind)]))
    return df.join(wanted, col(column) == F.col("wanted__"), "left_semi")


def where_in_rows(df: DataFrame, column: str, rows: DataFrame, rows_column: str) -> DataFrame:
    """Rows whose column is among another query's values."""
    wanted = rows.select(F.col(rows_column).alias("wanted__"))
    return df.join(wanted, col(column) == F.col("wanted__"), "left_semi")


def where_between(df: DataFrame, column: str, lower: Any = None, upper: Any = None) -> DataFrame:
    """lower <= column < upper; either bound may be left out, both out is no filter."""
    parts = []
    if lower is not None:
        parts.append(col(column) >= bound(df, column, lower))
    if upper is not None:
        parts.append(col(column) < bound(df, column, upper))
    return df.where(all_of(*parts)) if parts else df


def bound(df: DataFrame, column: str, value: Any) -> Column:
    """The value as the column's own type, so that the comparison reaches the scan."""
    if isinstance(value, Column):
        return value
    return F.lit(value).cast(df.select(col(column).alias("v")).schema["v"].dataType)


# predicates


def always() -> Column:
    return F.lit(True)


def never() -> Column:
    return F.lit(False)


def all_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a & b, parts, always()) if len(parts) != 1 else parts[0]


def any_of(*parts: Column) -> Column:
    return reduce(lambda a, b: a | b, parts, never()) if len(parts) != 1 else parts[0]


def negate(part: Column) -> Column:
    return ~part


_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b,
}


def compare(left: Column, op: str, value: Any, kind: T.DataType | None = None) -> Column:
    """One comparison; an enum counts as its underlying value."""
    if op not in _COMPARE:
        raise QueryNotSupported(f"no comparison {op!r}")
    value = value.value if isinstance(value, Enum) else value
    right = value if isinstance(value, Column) else F.lit(value)
    return _COMPARE[op](left, right.cast(kind) if kind is not None else right)


# search


class Match(Enum):
    CONTAINS = "contains"
    STARTS_WITH = "starts with"
    EXACT = "exact"


@dataclass(frozen=True)
class SearchSpec:
    """The string columns that a search term may look into, and how.  Wildcards in a term are plain characters."""

    fields: tuple[str, ...]
    match: Match = Match.CONTAINS

    def __post_init__(self):
        if not self.fields:
            raise QueryNotSupported("a search needs at least one field")

    def predicate(self, term: str) -> Column:
        def one(name: str) -> Column:
            c = col(name)
            if self.match is Match.EXACT:
                return c == F.lit(term)
            return c.isNotNull() & (c.contains(term) if self.match is Match.CONTAINS else c.startswith(term))

        return any_of(*(one(f) for f in self.fields))


class SearchSpecBuilder:
    def __init__(self):
        self._fields: list[str] = []
        self._match = Match.CONTAINS

    def field(self, name: str) -> "SearchSpecBuilder":
        self._fields.append(name)
        return self

    def match(self, match: Match) -> "SearchSpecBuilder":
        self._match = match
        return self

    def build(self) -> SearchSpec:
        return SearchSpec(tuple(self._fields), self._match)


def search(df: DataFrame, spec: SearchSpec, term: str | None) -> DataFrame:
    """Rows in which any field matches; a blank term is no filter."""
    term = (term or "").strip()
    return df.where(spec.predicate(term)) if term else df


# scopes of a synchronize


@dataclass(frozen=True)
class Scope:
    """Part of a table: a conjunction of `column op value`, or SQL over alias t with bound values."""

    terms: tuple[tuple[str, str, Any], ...] = ()
    text: str | None = None
    args: tuple[tuple[str, Any], ...] = ()

    @staticmethod
    def where(column: str, op: str, value: Any) -> "Scope":
        if op not in _COMPARE:
            raise WriteNotSupported(f"a scope can't compare by {op!r}")
        if isinstance(value, Column):
            raise WriteNotSupported("a scope compares a column with a value, not with a column")
        if value is None and op not in ("=", "<>"):
            raise WriteNotSupported("null can only be compared by = and <>")
        return Scope(((column, op, value),))

    @staticmethod
    def eq(column: str, value: Any) -> "Scope":
        return Scope.where(column, "=", value)

    @staticmethod
    def flag(column: str, value: bool = True) -> "Scope":
        return Scope.where(column, "=", value)

    @staticmethod
    def sql(text: str, **args: Any) -> "Scope":
        """SQL such as "t.tenant = :tenant"; values are bound, never spelt into the text."""
        return Scope(text=text, args=tuple(args.items()))

    def __and__(self, other: "Scope") -> "Scope":
        if self.text is not None or other.text is not None:
            raise WriteNotSupported("an SQL scope stands alone")
        return Scope(self.terms + other.terms)

    def within(self, df: DataFrame, model: TableModel, name: str) -> DataFrame:
        """`df` with a flag that says which rows are in scope; unknown counts as outside."""
        if self.text is None:
            return df.withColumn(name, F.coalesce(self.predicate(model), F.lit(False)))
        placed = set(_MARKER.findall(_QUOTED.sub(" ", self.text)))
        lost = sorted({n for n, _ in self.args} ^ placed)
        if lost:
            raise WriteNotSupported(f"the scope and its values don't agree on {', '.join(lost)}")
        text = self.text.replace("{", "{{").replace("}", "}}")  # the braces of a text are its own
        return df.sparkSession.sql(f"SELECT *, coalesce(({text}\n), false) AS `{name}` FROM {{scoped__}} AS t", args=dict(self.args), scoped__=df)

    def predicate(self, model: TableModel) -> Column:
        """A conjunction over the table's plain columns.  Unknown counts as outside: callers coalesce to false."""
        if self.text is not None:
            raise WriteNotSupported("an SQL scope has no predicate of its own")
        parts = []
        for column, op, value in self.terms:
            kind = model.type_of(column)
            if column in model.converters and value is not None:
                value = model.converters[column].to_store(value)
            if value is None:
                parts.append(col(column).isNull() if op == "=" else col(column).isNotNull())
            else:
                parts.append(compare(col(column), op, value, kind))
        if not parts:
            raise WriteNotSupported("a scope needs a condition")
        return all_of(*parts)


#: Texts, quoted names and comments, in which nothing is a marker.
_QUOTED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|::""", re.S)
_MARKER = re.compile(r":([A-Za-z_][A-Za-z0-9_]*)")
