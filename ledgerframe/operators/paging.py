"""Offset pages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryNotSupported
from ..model import col
from ..options import CountStrategy, QueryOptions
from .sorting import ASC, SortTerm, apply_order

INT32 = 2**31 - 1


@dataclass(frozen=True)
class PageRequest:
    page: int
    size: int | None = None

    @staticmethod
    def of(page: int, size: int | None = None) -> "PageRequest":
        if page < 0:
            raise QueryNotSupported("a page number isn't negative")
        if size is not None and size < 1:
            raise QueryNotSupported("a page has at least one row")
        return PageRequest(page, size)

    def resolve(self, options: QueryOptions) -> tuple[int, int]:
        """(offset, size); sizes above the most are taken down to it."""
        first = options.numbering.value
        if self.page < first:
            raise QueryNotSupported(f"pages begin with {first}")
        size = min(self.size or options.default_page_size, options.max_page_size)
        offset = (self.page - first) * size
        if offset > INT32:
            raise QueryNotSupported("the page is out of reach by offset")
        return offset, size


@dataclass(frozen=True)
class PagedResult:
    items: list[Row]
    page: int
    size: int
    total: int | None
    has_next: bool | None
    has_previous: bool
    df: DataFrame = field(repr=False, compare=False, default=None)

    @property
    def total_pages(self) -> int | None:
        return None if self.total is None else min(-(-self.total // self.size), INT32)


def slice_frame(df: DataFrame, offset: int, size: int) -> DataFrame:
    return df.offset(offset).limit(size)


#: Ranges of the leading column that a deep offset is counted off by.
RANGES = 64


def deep_slice(df: DataFrame, terms: list[SortTerm], offset: int, size: int) -> DataFrame:
    """The rows from `offset` on of unordered `df`: whole ranges of the leading column are counted in one pass and
    skipped by a filter, so that only the rest of the offset is counted off row by row.

    Where the leading column has no quantiles (text, expressions) the offset is counted off plainly."""
    path = terms[0].path
    kind = df.select(col(path).alias("v")).schema["v"].dataType if path is not None else None
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        number, back = F.unix_micros(col(path).cast("timestamp")), lambda x: F.timestamp_micros(F.lit(int(x))).cast(kind)
    elif isinstance(kind, T.NumericType):
        number, back = col(path).cast("double"), lambda x: F.lit(float(x)).cast("double")
    else:
        return slice_frame(apply_order(df, terms), offset, size)
    compared = col(path) if not isinstance(kind, T.NumericType) else col(path).cast("double")
    cuts = df.agg(F.percentile_approx(number, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("c")).first().c or []
    up = terms[0].direction == ASC
    cuts = sorted(set(cuts), reverse=not up)
    # rows that stand before all rows of a cut's value; nulls come first where the order ascends, last where it descends
    before = [F.count(F.when((compared < back(c)) | (F.isnull(compared) if up else F.lit(False)) if up else compared > back(c), 1)).alias(f"n{i}") for i, c in enumerate(cuts)]
    counts = list(df.agg(*before).first()) if cuts else []
    passed = [i for i, n in enumerate(counts) if n <= offset]
    if not passed:
        return slice_frame(apply_order(df, terms), offset, size)
    cut = back(cuts[passed[-1]])
    rest = df.where(compared >= cut if up else (compared <= cut) | F.isnull(compared))
    return slice_frame(apply_order(rest, terms), offset - counts[passed[-1]], size)


def to_page(df: DataFrame, request: PageRequest, options: QueryOptions = QueryOptions(), advise: Callable[..., None] | None = None, terms: list[SortTerm] | None = None) -> PagedResult:
    """A page of an ordered `df`; with `terms`, of an unordered one, whose offsets past `max_offset_rows` are counted
    off by ranges."""
    offset, size = request.resolve(options)
    if terms is not None and offset <= options.max_offset_rows:
        df, terms = apply_order(df, terms), None
    cut = (lambda n: slice_frame(df, offset, n)) if terms is None else (lambda n: deep_slice(df, terms, offset, n))
    if advise is not None:
        advise(df, offset)
    has_previous = request.page > options.numbering.value
    if options.count is CountStrategy.TOTAL_COUNT:
        total = df.count()
        frame = cut(size)
        items = frame.collect()  # at most size
        return PagedResult(items, request.page, size, total, offset + len(items) < total, has_previous, frame)
    probe = options.count is CountStrategy.HAS_NEXT_PROBE
    frame = cut(size + probe)
    items = frame.collect()
    return PagedResult(items[:size], request.page, size, None, len(items) > size if probe else None, has_previous, frame)
