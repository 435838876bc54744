"""Audit payloads and entity keys as built-in column expressions: no row leaves the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_value(c: Column, kind: T.DataType) -> Column:
    """The value as JSON text: numbers plain, decimals at their smallest exact scale, times as ISO text, binary as
    base64, null as null."""
    text = stored_text(c, kind)
    if isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)):
        return F.coalesce(text, F.lit("null"))
    if isinstance(kind, (T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)) or type(kind).__name__ == "TimeType":
        return quoted(text)
    whole = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def quoted(text: Column) -> Column:
    whole = F.to_json(F.struct(text.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def decimal_text(c: Column) -> Column:
    """Decimal digits without trailing zeros; no negative zero."""
    text = c.cast("string")
    short = F.when(F.instr(text, ".") > 0, F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    return F.when(short.isin("-0", ""), F.lit("0")).otherwise(short)


def stored_text(c: Column, kind: T.DataType) -> Column:
    """One text form for a stored value; null stays null."""
    if isinstance(kind, T.DecimalType):
        return decimal_text(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("true")).when(~c, F.lit("false"))
    return c.cast("string")


def key_text(parts: list[tuple[Column, T.DataType]]) -> Column:
    """One part as it is; several escaped and joined by |, null as empty."""
    texts = [F.coalesce(stored_text(c, k), F.lit("")) for c, k in parts]
    if len(texts) == 1:
        return texts[0]
    return F.concat_ws("|", *[F.regexp_replace(t, r"([|\\])", r"\\$1") for t in texts])


def joined(fragments: list[Column]) -> Column:
    """Fragments that aren't null, by commas."""
    return F.array_join(F.array_compact(F.array(*fragments)), ",") if fragments else F.lit("")


def object_of(pairs: list[tuple[str, Column, Column | None]]) -> Column:
    """A JSON object; a pair with a condition is there only where it holds."""
    parts = []
    for name, value, when in pairs:
        fragment = F.concat(F.lit(f"{json.dumps(name, ensure_ascii=False)}:"), value)
        parts.append(fragment if when is None else F.when(when, fragment))
    return F.concat(F.lit("{"), joined(parts), F.lit("}"))


def contains(payload: Column, wanted: dict, path: str = "$") -> Column:
    """Whether the JSON document has everything that `wanted` has: nested objects, and lists as subsets."""
    tests = []
    for name, value in wanted.items():
        at = f"{path}.{name}" if name.replace("_", "").isalnum() else f"{path}['{name}']"
        found = F.get_json_object(payload, at)
        if isinstance(value, dict):
            tests.append(contains(payload, value, at))
        elif isinstance(value, list):
            items = F.from_json(found, "array<string>")
            tests += [F.array_contains(items, F.lit(v if isinstance(v, str) else json.dumps(v))) for v in value]
        elif value is None:
            tests.append(found.isNull() & F.array_contains(F.json_object_keys(F.get_json_object(payload, path)), F.lit(name)))
        else:
            tests.append(found == F.lit(value if isinstance(value, str) else json.dumps(value)))
    return F.coalesce(reduce(lambda a, b: a & b, tests, F.lit(True)), F.lit(False))


def changed_contains(payload: Column, name: str) -> Column:
    return F.coalesce(F.array_contains(F.from_json(F.get_json_object(payload, "$.changed"), "array<string>"), F.lit(name)), F.lit(False))


Redactor = Callable[[Column], Column]
