"""Text forms of cursor values, each checked to read back as itself."""

from __future__ import annotations

import base64
import binascii
import datetime as dt
import decimal
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import types as T

from ..errors import QueryNotSupported

_CUSTOM: dict[type, tuple[Callable[[Any], str], Callable[[str], Any]]] = {}


def register(kind: type[T.DataType], encode: Callable[[Any], str], decode: Callable[[str], Any]) -> None:
    """A codec for a column type that has none."""
    _CUSTOM[kind] = (encode, decode)


def _whole(text: str) -> int:
    if not re.fullmatch(r"-?[0-9]+", text):
        raise ValueError(text)
    return int(text)


def _flag(text: str) -> bool:
    return {"1": True, "0": False}[text]


def _stamp(text: str) -> dt.datetime:
    x = dt.datetime.fromisoformat(text)
    return x if x.tzinfo is None else x.astimezone(dt.timezone.utc).replace(tzinfo=None)


def _pair(kind: T.DataType) -> tuple[Callable[[Any], str], Callable[[str], Any]]:
    if type(kind) in _CUSTOM:
        return _CUSTOM[type(kind)]
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return (lambda v: str(int(v))), _whole
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (lambda v: repr(float(v))), float
    if isinstance(kind, T.DecimalType):
        return (lambda v: format(v, "f")), decimal.Decimal
    if isinstance(kind, T.BooleanType):
        return (lambda v: "1" if v else "0"), _flag
    if isinstance(kind, T.StringType):
        return str, str
    if isinstance(kind, T.DateType):
        return (lambda v: v.isoformat()), dt.date.fromisoformat
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return (lambda v: v.isoformat(timespec="microseconds")), _stamp
    if isinstance(kind, T.BinaryType):
        return (lambda v: base64.b64encode(bytes(v)).decode()), lambda t: base64.b64decode(t, validate=True)
    if isinstance(kind, T.DayTimeIntervalType):
        return (lambda v: str(round(v.total_seconds() * 1_000_000))), lambda t: dt.timedelta(microseconds=_whole(t))
    if type(kind).__name__ == "TimeType":
        return (lambda v: v.isoformat(timespec="microseconds")), dt.time.fromisoformat
    raise QueryNotSupported(f"a cursor can't carry {kind.simpleString()}")


def carries(kind: T.DataType) -> bool:
    try:
        _pair(kind)
        return True
    except QueryNotSupported:
        return False


def encode(value: Any, kind: T.DataType) -> str:
    write, read = _pair(kind)
    text = write(value)
    back = read(text)
    same = back == value or (isinstance(kind, (T.BinaryType,)) and bytes(back) == bytes(value)) or write(back) == text
    if not same:
        raise QueryNotSupported(f"{value!r} doesn't read back from a cursor")
    return text


def decode(text: str, kind: T.DataType) -> Any:
    try:
        return _pair(kind)[1](text)
    except (ValueError, KeyError, decimal.InvalidOperation, binascii.Error) as e:
        raise QueryNotSupported(f"the cursor's value {text!r} isn't a {kind.simpleString()}") from e
