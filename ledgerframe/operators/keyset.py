"""Keyset pages: rows after a boundary in a proven total order, with opaque cursors.

A page is a filter on the boundary, an ordering and a limit, which the planner runs as a top-k over a pruned scan:
no offset is counted off, and a deep page costs what the first does.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..errors import QueryNotSupported
from ..model import TableModel, col
from ..options import QueryOptions
from . import codec
from .sorting import ASC, DESC, SortTerm, apply_order

VERSION = "1"
FORWARD, BACKWARD = "f", "b"


@dataclass(frozen=True)
class KeysetCursor:
    """Where a page ended: the ordering's fingerprint, the direction and the boundary row's stored values."""

    fingerprint: str
    direction: str
    values: tuple[str, ...]

    def token(self) -> str:
        text = "|".join([VERSION, self.fingerprint, self.direction, *(quote(v, safe="") for v in self.values)])
        return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")

    __str__ = token

    @staticmethod
    def parse(token: str) -> "KeysetCursor":
        found = KeysetCursor.try_parse(token)
        if found is None:
            raise QueryNotSupported("the cursor can't be read")
        return found

    @staticmethod
    def try_parse(token: str | None) -> "KeysetCursor | None":
        if not (token or "").strip():
            return None
        try:
            raw = base64.b64decode(token + "=" * (-len(token) % 4), altchars=b"-_", validate=True).decode()
        except (binascii.Error, ValueError):
            return None
        parts = raw.split("|")
        if len(parts) < 4 or parts[0] != VERSION or parts[2] not in (FORWARD, BACKWARD) or not parts[1]:
            return None
        values = []
        for p in parts[3:]:
            v = unquote(p, errors="replace")
            if quote(v, safe="") != p:
                return None
            values.append(v)
        return KeysetCursor(parts[1], parts[2], tuple(values))


@dataclass(frozen=True)
class KeysetDefinition:
    """An ordered list of columns that pages follow."""

    model: TableModel
    terms: tuple[SortTerm, ...]
    allow_non_unique: bool = False
    allow_converted: bool = False

    def __post_init__(self):
        if not self.terms:
            raise QueryNotSupported("a keyset needs a column")
        paths = [t.path for t in self.terms]
        if None in paths:
            raise QueryNotSupported("a keyset orders by columns, not by expressions")
        if len(set(paths)) != len(paths):
            raise QueryNotSupported("a keyset names a column once")
        for p in paths:
            self.model.type_of(p)

    @property
    def paths(self) -> list[str]:
        return [t.path for t in self.terms]

    @property
    def fingerprint(self) -> str:
        text = self.model.name + "".join(f"|{t.path}:{'a' if t.direction == ASC else 'd'}" for t in self.terms)
        return hashlib.sha256(text.encode()).digest()[:8].hex()

    def validate(self) -> None:
        """Refuses orderings that could skip or repeat rows."""
        for p in self.paths:
            if p not in self.model.never_null:
                raise QueryNotSupported(f"{p} may be null, and null has no place in a keyset")
        for p in self.paths:
            c = self.model.converters.get(p)
            if c is not None and not c.order_preserving and not self.allow_converted:
                raise QueryNotSupported(f"{p} is stored in an order of its own")
        for p in self.paths:
            if not codec.carries(self.model.type_of(p)):
                raise QueryNotSupported(f"a cursor can't carry {p}")
        if not self.allow_non_unique and not self.total:
            raise QueryNotSupported(f"{', '.join(self.paths)} doesn't name a row of {self.model.name}; add a key")

    @property
    def total(self) -> bool:
        return any(set(u) <= set(self.paths) for u in self.model.total_orders)

    def order(self, df: DataFrame, backward: bool = False) -> DataFrame:
        return apply_order(df, [t.reversed() for t in self.terms] if backward else self.terms)

    def after(self, values: list[Any], backward: bool = False) -> Column:
        """Rows past the boundary, lexicographically.  The leading column's own bound is stated as well, since that
        alone prunes row groups and files."""
        lits = [F.lit(v).cast(self.model.type_of(p)) for v, p in zip(values, self.paths)]
        arms, lead = [], None
        for i, t in enumerate(self.terms):
            up = (t.direction == ASC) != backward
            c = col(t.path)
            past = c > lits[i] if up else c < lits[i]
            arms.append(reduce(lambda a, b: a & b, [*(col(self.paths[k]) == lits[k] for k in range(i)), past]))
            if i == 0:
                lead = c >= lits[i] if up else c <= lits[i]
        rest = reduce(lambda a, b: a | b, arms)
        return rest if len(self.terms) == 1 else lead & rest

    def cursor(self, row: Row, backward: bool = False) -> KeysetCursor:
        values = []
        for p in self.paths:
            v = row
            for part in p.split("."):
                v = v[part]
            if v is None:
                raise QueryNotSupported(f"{p} is null in a row of the page")
            values.append(codec.encode(v, self.model.type_of(p)))
        return KeysetCursor(self.fingerprint, BACKWARD if backward else FORWARD, tuple(values))

    def boundary(self, cursor: KeysetCursor) -> list[Any]:
        if cursor.fingerprint != self.fingerprint:
            raise QueryNotSupported("the cursor belongs to another ordering")
        if len(cursor.values) != len(self.terms):
            raise QueryNotSupported("the cursor has another number of values than the ordering")
        return [codec.decode(v, self.model.type_of(p)) for v, p in zip(cursor.values, self.paths)]

    def stored(self, values: list[Any]) -> list[Any]:
        """Model values as they are stored.  A value that doesn't come back from the store as itself is refused."""
        out = []
        for p, v in zip(self.paths, values):
            c = self.model.converters.get(p)
            if c is not None:
                kept = c.to_store(v)
                if kept is not None and c.from_store(kept) != v:
                    raise QueryNotSupported(f"{p}: {v!r} doesn't come back from the store")
                v = kept
            if v is None:
                raise QueryNotSupported(f"{p} would be null")
            out.append(v)
        return out

    def cursor_at(self, values: list[Any], backward: bool = False) -> KeysetCursor:
        """The cursor of a boundary given in model values."""
        if len(values) != len(self.terms):
            raise QueryNotSupported("a boundary has a value for each column of the ordering")
        texts = tuple(codec.encode(v, self.model.type_of(p)) for p, v in zip(self.paths, self.stored(values)))
        return KeysetCursor(self.fingerprint, BACKWARD if backward else FORWARD, texts)

    def modelled(self, row: Row) -> dict[str, Any]:
        """A row's ordering columns as model values."""
        out = {}
        for p in self.paths:
            v = row
            for part in p.split("."):
                v = v[part]
            c = self.model.converters.get(p)
            out[p] = c.from_store(v) if c is not None and v is not None else v
        return out


class KeysetBuilder:
    def __init__(self, model: TableModel):
        self._model, self._terms, self._flags = model, [], {}

    def ascending(self, path: str) -> "KeysetBuilder":
        self._terms.append(SortTerm(path, ASC) if isinstance(path, str) else SortTerm(None, ASC, path))
        return self

    def descending(self, path: str) -> "KeysetBuilder":
        self._terms.append(SortTerm(path, DESC) if isinstance(path, str) else SortTerm(None, DESC, path))
        return self

    def allow_non_unique(self) -> "KeysetBuilder":
        self._flags["allow_non_unique"] = True
        return self

    def allow_converted(self) -> "KeysetBuilder":
        self._flags["allow_converted"] = True
        return self

    def build(self) -> KeysetDefinition:
        return KeysetDefinition(self._model, tuple(self._terms), **self._flags)


@dataclass(frozen=True)
class KeysetPage:
    items: list[Row]
    size: int
    has_next: bool
    has_previous: bool
    next: str | None
    previous: str | None
    df: DataFrame = field(repr=False, compare=False, default=None)


def page_frame(df: DataFrame, keys: KeysetDefinition, size: int, cursor: KeysetCursor | None = None) -> DataFrame:
    """The page's rows as a DataFrame, in page order for a forward cursor, reversed for a backward one."""
    backward = cursor is not None and cursor.direction == BACKWARD
    if cursor is not None:
        df = df.where(keys.after(keys.boundary(cursor), backward))
    return keys.order(df, backward).limit(size)


def keyset_page(df: DataFrame, keys: KeysetDefinition, size: int | None = None, cursor: str | KeysetCursor | None = None, options: QueryOptions = QueryOptions(), advise: Callable[..., None] | None = None) -> KeysetPage:
    size = min(size or options.default_page_size, options.max_page_size)
    if size < 1:
        raise QueryNotSupported("a page has at least one row")
    keys.validate()
    if advise is not None:
        advise(df, keys)
    return _page(df, keys, size, KeysetCursor.parse(cursor) if isinstance(cursor, str) else cursor)


def _page(df: DataFrame, keys: KeysetDefinition, size: int, cursor: KeysetCursor | None) -> KeysetPage:
    backward = cursor is not None and cursor.direction == BACKWARD
    frame = page_frame(df, keys, size + 1, cursor)
    rows = frame.collect()  # at most size + 1
    extra, rows = len(rows) > size, rows[:size]
    if backward:
        rows = rows[::-1]
    has_next = backward or extra
    has_previous = extra if backward else cursor is not None
    return KeysetPage(
        rows, size, has_next, has_previous,
        keys.cursor(rows[-1]).token() if rows and has_next else None,
        keys.cursor(rows[0], backward=True).token() if rows and has_previous else None,
        frame,
    )


def walk(df: DataFrame, keys: KeysetDefinition, size: int) -> Iterator[KeysetPage]:
    """Forward pages to the end; none is empty."""
    cursor = None
    while True:
        page = _page(df, keys, size, cursor)
        if page.items:
            yield page
        if page.next is None:
            return
        cursor = KeysetCursor.parse(page.next)
