"""Document fingerprints by locally consistent parsing.

A text's bytes are parsed into phrases level by level.  Runs of one symbol become a phrase of their own kind;
elsewhere deterministic coin tossing - the place and value of the lowest bit in which a symbol differs from the one
before, applied until few values are left - marks the local maxima at which phrases begin.  A phrase is named by a
hash of the names in it, and the names are the symbols of the next level.  Where a phrase begins depends on a few
symbols around it alone, so equal substrings are parsed alike but for their edges, wherever they stand.

A fingerprint is the name of the whole text and the `sketch` smallest distinct names of the phrases of one level.
A text of fewer than `few` such names also keeps those of the level below, as its phrases are too long to show what
two short texts share.  The likeness of two fingerprints is the share of common names among the smallest of both,
of both levels where both texts keep them (1 for equal whole names).

For the comparison with the following text, rows are put into ranges of ids, each sorted in its task; what joins a
range's last row with the next range's first is a row each.  Neither the driver nor a broadcast holds anything that
grows with the rows.  With 64 names a likeness is an estimate with an error near 0.06; texts of fewer than some 900
characters have fewer phrases and are compared by all of them.

Defined results: a null text is empty; an empty text's fingerprint has no phrase names and is like another empty
one alone; rows are ordered by id (null first), then the text's hash; repeated rows follow each other; a single row follows
itself; an empty table gives an empty result; columns besides doc_id and text are not read.  Texts are parsed whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import columns, kept, mix, pieces, position_weights, slices, text_buffer


@dataclass(frozen=True)
class PrintSpec:
    """level: the phrases of how many parses are sketched; few: below how many names the level before counts too;
    block_rows: rows of a range."""

    level: int = 3
    sketch: int = 64
    few: int = 12
    block_rows: int = 8192


def _lowest_bit(x: np.ndarray) -> np.ndarray:
    """Number of the lowest set bit of each nonzero x."""
    low = x & (~x + np.ones(1, x.dtype))
    return np.log2(low.astype(np.float64)).astype(np.uint8)


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round: twice the lowest differing bit, plus its value, against the symbol before.  Neighbours that
    differ keep differing.  At a text's first symbol: its own lowest bit's value."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = ~symbols[first]
    bit = _lowest_bit(symbols ^ before)
    return (2 * bit + ((symbols >> bit.astype(symbols.dtype)) & np.ones(1, symbols.dtype)).astype(np.uint8)).astype(np.uint8)


def coin_tables() -> np.ndarray:
    """The round's outcome for 8-bit symbols, by (symbol, symbol before)."""
    x = np.arange(256, dtype=np.uint8)
    diff = x[:, None] ^ x[None, :]
    low = np.zeros(256, np.uint8)
    for v in range(1, 256):
        low[v] = (v & -v).bit_length() - 1
    bit = low[diff]
    return (2 * bit + ((x[:, None] >> bit) & 1)).astype(np.uint8)


_COIN = coin_tables()


def parse(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of each sequence symbols[at[i]:at[i+1]], and where they begin (as `at`)."""
    n = len(symbols)
    if n == 0:
        return np.zeros(0, np.uint64), at
    text_start = np.zeros(n + 1, bool)
    text_start[at[:-1]] = True
    same = np.zeros(n, bool)  # equal to the symbol before, in the same text
    same[1:] = (symbols[1:] == symbols[:-1]) & ~text_start[1:n]
    # runs of one symbol become one unit
    unit = np.flatnonzero(~same)
    size = np.diff(np.append(unit, n))
    value = symbols[unit]
    long = size > 1
    wide = value.astype(np.uint64)
    wide = np.where(long, mix(wide * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64)), wide)
    first = text_start[unit]
    m = len(unit)
    # coins on the units' values; units of neighbouring runs differ in value, so coins are defined everywhere
    heads = np.flatnonzero(first)
    if symbols.dtype == np.uint8:
        before = np.empty_like(value)
        before[1:] = value[:-1]
        before[heads] = ~value[heads]
        coin = _COIN[value, before]
    else:
        coin = _toss(value, heads)
    for _ in range(2):
        before = np.empty_like(coin)
        before[1:] = coin[:-1]
        before[heads] = ~coin[heads]
        coin = _COIN[coin, before]
    # phrases begin at local maxima and at texts' starts, and a long run is a phrase by itself
    begin = first.copy()
    if m > 2:
        peak = np.zeros(m, bool)
        peak[1:-1] = (coin[1:-1] > coin[:-2]) & (coin[1:-1] > coin[2:])
        last = np.zeros(m, bool)
        last[heads[1:] - 1] = True
        begin |= peak & ~last
    begin |= long
    begin[1:] |= long[:-1]
    starts = np.flatnonzero(begin)
    length = np.diff(np.append(starts, m))
    place = np.arange(m) - np.repeat(starts, length)
    w = position_weights(int(length.max()) + 1)
    # a unit of one phrase alone and the symbol itself are told apart by the length in the name
    names = mix(np.add.reduceat((wide + np.uint64(1)) * w[place], starts) + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return names, np.searchsorted(unit[starts], at)


#: The whole text's name, the names of its phrases, and those of the level below where the former are few.
Print = tuple[np.uint64, np.ndarray, np.ndarray]


def smallest(names: np.ndarray, at: np.ndarray, most: int) -> list[np.ndarray]:
    """The `most` smallest distinct 32-bit names of each sequence names[at[i]:at[i+1]]."""
    row = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    key = np.unique((row << np.uint64(32)) | (mix(names) >> np.uint64(32)).astype(np.uint64))
    cut = np.searchsorted(key, np.arange(len(at), dtype=np.uint64) << np.uint64(32))
    low = key & np.uint64(0xFFFFFFFF)
    return [low[a : min(b, a + most)] for a, b in zip(cut[:-1], cut[1:])]


def fingerprints(column: pa.Array, spec: PrintSpec) -> list[Print]:
    """The fingerprint of each text."""
    symbols, at = text_buffer(column)
    whole, named = np.zeros(len(column), np.uint64), np.diff(at) == 0
    below, sketched, level = None, None, 0
    while sketched is None or not named.all():
        symbols, at = parse(symbols, at)
        level += 1
        if level == spec.level - 1:
            below = symbols, at
        if level == spec.level:
            sketched = symbols, at
        one = ~named & (np.diff(at) == 1)  # a text is named at the first level where it is one phrase
        whole[one] = symbols[at[:-1][one]]
        named |= one
    names = smallest(*sketched, spec.sketch)
    if below is None:
        return list(zip(whole, names, [names[0][:0]] * len(names)))
    size = np.where([len(x) < spec.few for x in names], np.diff(below[1]), 0)
    short = below[0][np.repeat(size > 0, np.diff(below[1]))]
    return list(zip(whole, names, smallest(short, np.concatenate([[0], np.cumsum(size)]), spec.sketch)))


def told(print_: Print) -> str:
    whole, *levels = print_
    return ":".join([f"{int(whole):016x}", *[x.astype(">u4").tobytes().hex() for x in levels if x is levels[0] or len(x)]])


def likeness(a: Print, b: Print, sketch: int) -> float:
    """Share of common names among the `sketch` smallest names of both."""
    if a[0] == b[0]:
        return 1.0
    if not len(a[1]) or not len(b[1]):
        return 0.0
    one, two = a[1], b[1]
    if len(a[2]) and len(b[2]):
        one, two = np.union1d(one, a[2]), np.union1d(two, b[2])
    both = np.union1d(one, two)[:sketch]
    return float(np.isin(both, np.intersect1d(one, two, assume_unique=True), assume_unique=True).mean())


def print_texts(docs: DataFrame, spec: PrintSpec = PrintSpec()) -> DataFrame:
    """doc_id and fingerprint of every row; nothing is shuffled."""
    def run(batches):
        for whole_batch in batches:
            for batch in slices(whole_batch):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([told(x) for x in fingerprints(batch.column("text"), spec)], pa.string())], ["doc_id", "fingerprint"])

    return columns(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, fingerprint string")


_RESULT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _RESULT.split(", ")]
#: Between tasks and on disk, digests and fingerprints are bytes: half of their text.
_RAW = _RESULT.replace("string", "binary")
_TYPES = [{"bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[x.split()[1]] for x in _RAW.split(", ")]


def packed(print_: Print) -> bytes:
    """The whole name, how many names of the first kind (2 bytes), and the names of both kinds."""
    whole, names, below = print_
    return int(whole).to_bytes(8, "big") + len(names).to_bytes(2, "big") + names.astype(">u4").tobytes() + below.astype(">u4").tobytes()


def shown(rows: DataFrame) -> DataFrame:
    """Rows with digests and fingerprints as text."""

    def text(c: str):
        name = lambda start, n: F.lower(F.hex(F.substring(c, start, n)))
        size = F.conv(F.hex(F.substring(c, 9, 2)), 16, 10).cast("int") * 4
        rest = F.lower(F.hex(F.substring(c, size + 11, F.lit(2**31 - 1))))
        return F.concat(name(1, 8), F.lit(":"), name(11, size), F.when(rest != "", F.concat(F.lit(":"), rest)).otherwise(F.lit(""))).alias(c)

    return rows.select("doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")


def compared(ids: pa.Array, texts: list[str], after: list[str], spec: PrintSpec) -> pa.RecordBatch:
    """Results of texts each followed by `after`."""
    edits = [t[: len(t) - len(t) // 2] + a[: len(t) // 2] for t, a in zip(texts, after)]
    chain = after[:-1] == texts[1:]  # a run of rows: all but one of the following texts are there already
    whole = fingerprints(pa.array([*texts, after[-1]] if chain else [*texts, *after], pa.large_string()), spec)
    own, then = whole[: len(texts)], whole[1:] if chain else whole[len(texts) :]
    b = fingerprints(pa.array(edits, pa.large_string()), spec)
    return pa.RecordBatch.from_arrays([
        ids, pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t.encode()).digest() for t in edits], pa.binary()),
        pa.array([packed(x) for x in own], pa.binary()), pa.array([packed(x) for x in b], pa.binary()),
        pa.array([likeness(x, y, spec.sketch) for x, y in zip(own, b)], pa.float64()), pa.array([likeness(x, y, spec.sketch) for x, y in zip(own, then)], pa.float64()),
    ], _NAMES)


def compare_with_next(docs: DataFrame, spec: PrintSpec = PrintSpec()) -> DataFrame:
    """Fingerprints of every row's text and of its edit, whose last half comes from the following row, and how
    like they and the following row's are.

    Rows are put in ranges of ids once; a task reads its range in order, a slice at a time.  Only the last row of a range
    has to wait for another's first: both leave with their texts, a row each, and are matched afterwards."""
    source = columns(docs, doc_id="bigint", text="string")
    blocks = pieces(source.count(), spec.block_rows)
    # rows of one id go by their texts' hash, and equal rows, whose order is all one, by a number of their own
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.rand(spec.level)]
    ranged = source.withColumns({"h": order[1], "r": order[2]}).repartitionByRange(blocks, order[0], "h", "r").sortWithinPartitions(order[0], "h")

    def run(batches):
        from pyspark import TaskContext

        part, carried = TaskContext.get().partitionId(), None

        def row(edge: str, doc_id, text: str) -> pa.RecordBatch:
            columns_ = [pa.array([doc_id], pa.int64()), *[pa.nulls(1, t) for t in _TYPES[1:]]]
            return pa.RecordBatch.from_arrays([*columns_, pa.array([part], pa.int64()), pa.array([edge]), pa.array([text])], [*_NAMES, "part", "edge", "text"])

        for whole in batches:
            for batch in slices(whole, most=1 << 20):
                ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
                if carried is None:
                    yield row("first", ids[0], texts[0])
                else:
                    ids, texts = [carried[0], *ids], [carried[1], *texts]
                carried = ids[-1], texts[-1]
                if len(texts) > 1:
                    done = compared(pa.array(ids[:-1], pa.int64()), texts[:-1], texts[1:], spec)
                    n = done.num_rows
                    yield pa.RecordBatch.from_arrays([*done.columns, pa.array([part] * n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], [*_NAMES, "part", "edge", "text"])
        if carried is not None:
            yield row("last", *carried)

    told_ = kept(ranged.select("doc_id", "text").mapInArrow(run, f"{_RAW}, part bigint, edge string, text string"), "prints")
    edges = told_.where(F.col("edge").isNotNull()).select("part", "edge", "doc_id", "text")
    # which range follows which, the first one the last: a number for each range
    parts = edges.where("edge = 'first'").select("part")
    least = parts.agg(F.min("part").alias("p")).first().p
    follow = parts.withColumn("then", F.coalesce(F.lead("part").over(W.orderBy("part")), F.lit(least)))
    first = edges.where("edge = 'first'").select(F.col("part").alias("then"), F.col("text").alias("after"))
    pairs = edges.where("edge = 'last'").join(follow, "part").join(first, "then").select("doc_id", "text", "after")

    def close(batches):
        for whole in batches:
            for batch in slices(whole):
                yield compared(batch.column("doc_id"), batch.column("text").to_pylist(), batch.column("after").to_pylist(), spec)

    return shown(told_.where(F.col("edge").isNull()).select(*_NAMES).unionAll(pairs.mapInArrow(close, _RAW)))
