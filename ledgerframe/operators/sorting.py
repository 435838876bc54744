"""Sorting by an allowlist that always yields a total order where a tiebreaker is given."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ..errors import QueryNotSupported
from ..model import col

ASC, DESC = "asc", "desc"
_WORDS = {"asc": ASC, "ascending": ASC, "desc": DESC, "descending": DESC}


@dataclass(frozen=True)
class SortField:
    name: str
    direction: str = ASC

    def __str__(self):
        return f"{self.name}:{self.direction}"


@dataclass(frozen=True)
class SortRequest:
    """What a caller asks for: `total:desc,-placed,+id`."""

    fields: tuple[SortField, ...] = ()

    @staticmethod
    def of(fields: Iterable[SortField]) -> "SortRequest":
        fields = tuple(fields)
        if any(not f.name.strip() for f in fields):
            raise QueryNotSupported("a sort field needs a name")
        return SortRequest(fields)

    @staticmethod
    def parse(text: str | None) -> "SortRequest":
        if not (text or "").strip():
            return SortRequest()
        return SortRequest(tuple(_parse_term(t) for t in text.split(",")))

    @staticmethod
    def try_parse(text: str | None) -> "SortRequest | None":
        try:
            return SortRequest.parse(text)
        except QueryNotSupported:
            return None

    def __str__(self):
        return ",".join(map(str, self.fields))

    def __bool__(self):
        return bool(self.fields)


_TERM = re.compile(r"\s*(?P<sign>[-+]?)\s*(?P<name>[^:]*?)\s*(?::\s*(?P<word>[^:]*?)\s*)?", re.S)


def _parse_term(text: str) -> SortField:
    m = _TERM.fullmatch(text)
    if m is None or not m["name"]:
        raise QueryNotSupported(f"not a sort term: {text.strip()!r}")
    if m["word"] is None:
        return SortField(m["name"], DESC if m["sign"] == "-" else ASC)
    direction = _WORDS.get(m["word"].lower())
    if direction is None:
        raise QueryNotSupported(f"unknown direction in {text.strip()!r}")
    if m["sign"] == "-":
        raise QueryNotSupported(f"the direction is given twice in {text.strip()!r}")
    return SortField(m["name"], direction)


@dataclass(frozen=True)
class SortTerm:
    """An ordering by a column path, or by an expression (path None)."""

    path: str | None
    direction: str = ASC
    expression: Column | None = field(default=None, compare=False)

    def column(self) -> Column:
        c = self.expression if self.path is None else col(self.path)
        return c.asc_nulls_first() if self.direction == ASC else c.desc_nulls_last()

    def reversed(self) -> "SortTerm":
        return SortTerm(self.path, DESC if self.direction == ASC else ASC, self.expression)


def term(what: str | Column, direction: str = ASC) -> SortTerm:
    return SortTerm(what, direction) if isinstance(what, str) else SortTerm(None, direction, what)


def apply_order(df: DataFrame, terms: Iterable[SortTerm]) -> DataFrame:
    terms = list(terms)
    return df.orderBy(*[t.column() for t in terms]) if terms else df


@dataclass(frozen=True)
class SortSpec:
    allowed: dict[str, SortTerm]
    default: tuple[SortField, ...]
    tiebreaker: SortTerm | None

    def resolve(self, request: SortRequest | str | None) -> list[SortTerm]:
        request = SortRequest.parse(request) if request is None or isinstance(request, str) else request
        terms, seen = [], set()
        for f in request.fields or self.default:
            found = self.allowed.get(f.name.lower())
            if found is None:
                raise QueryNotSupported(f"can't sort by {f.name!r}; allowed: {', '.join(sorted(self.allowed))}")
            if f.name.lower() in seen:
                raise QueryNotSupported(f"{f.name!r} is sorted by twice")
            seen.add(f.name.lower())
            terms.append(SortTerm(found.path, f.direction, found.expression))
        t = self.tiebreaker
        if t is not None and not any(x.path is not None and x.path == t.path for x in terms):
            terms.append(t)
        return terms


class SortSpecBuilder:
    """Names are matched whatever their case."""

    def __init__(self):
        self._allowed: dict[str, SortTerm] = {}
        self._default: list[SortField] = []
        self._tiebreaker: SortTerm | None = None

    def allow(self, name: str, what: str | Column | None = None) -> "SortSpecBuilder":
        if not name.strip():
            raise QueryNotSupported("a sort field needs a name")
        if name.lower() in self._allowed:
            raise QueryNotSupported(f"{name!r} is allowed twice")
        self._allowed[name.lower()] = term(name if what is None else what)
        return self

    def default_order(self, name: str, direction: str = ASC) -> "SortSpecBuilder":
        self._default.append(SortField(name, direction))
        return self

    def tiebreaker(self, what: str | Column, direction: str = ASC) -> "SortSpecBuilder":
        self._tiebreaker = term(what, direction)
        return self

    def build(self) -> SortSpec:
        if not self._allowed and self._tiebreaker is None:
            raise QueryNotSupported("a sort specification needs a field")
        if not self._default and self._tiebreaker is None:
            raise QueryNotSupported("a sort specification needs a default order or a tiebreaker")
        bad = [f.name for f in self._default if f.name.lower() not in self._allowed]
        if bad:
            raise QueryNotSupported(f"the default order uses {', '.join(bad)}, which isn't allowed")
        return SortSpec(dict(self._allowed), tuple(self._default), self._tiebreaker)


def order_by(df: DataFrame, spec: SortSpec, request: SortRequest | str | None = None) -> DataFrame:
    return apply_order(df, spec.resolve(request))
