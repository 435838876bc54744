"""Sequence packing by minimum bin slack.

Each text becomes token ids and a closing id; ids are cut into pieces of the window's length and a remainder.
Whole pieces fill windows of their own.  Remainders are packed in blocks: per window, a subset-sum dynamic
programme over a bitset of reachable fills picks the multiset of remaining lengths that comes closest to the
capacity, the counts are read back from the bitsets before each step, and the multiset is used as often as the
remaining counts allow.

Blocks are dealt by a hash of id, place and checksum and hold the pieces of about `block_docs` rows, so neither an id
nor a source gathers in one and no task grows with the input.  Remainders longer than half a window may outnumber
those that fit beside them, so about every sixteenth remainder (by checksum) takes its ids along and is cut as needed:
first into the windows that the multisets left open, then end to end into windows of its own.  One window a block
stays partly filled.  Of all other pieces only (id, start, length, checksum) rows are shuffled.

Defined results: a null or empty text is the closing id alone; repeated rows and null ids are packed like any
other row; an empty table gives an empty result; columns besides doc_id and text are not read; a text of any
length is cut into as many pieces as it needs.
"""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, pieces, slices

WINDOW = 1024

#: One remainder in so many may be cut into any pieces.
LOOSE = 16

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"


@cache
def whole_file(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def encoder(path: str, ranks: str):
    """text -> ids of the tokenizers file at `path`.  The same vocabulary as ranks gives the same ids several
    times faster; texts in which a special token is spelt out go through the file itself, which is loaded for the
    first of them."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return whole_file(path).encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def closest_fill(counts: list[int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within `counts` (indexed by length), whose sum comes closest to `capacity` from
    below: bounded subset sums as bits of an integer, lengths from long to short, counts by doubling."""
    reach, steps, full = 1, [], 1 << capacity
    mask = (full << 1) - 1
    for length in range(min(capacity, len(counts) - 1), 0, -1):
        left = min(counts[length], capacity // length)
        times = 1
        while left > 0 and not reach & full:
            take = min(times, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, times = left - take, times * 2
        if reach & full:
            break
    at, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def fill_windows(counts: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(multiset, times) until `counts` (by length, consumed) are used up.  A window starts with the longest
    remaining length; the rest is its closest fill."""
    out, longest = [], len(counts) - 1
    while True:
        while longest > 0 and not counts[longest]:
            longest -= 1
        if longest <= 0:
            return out
        counts[longest] -= 1
        used = closest_fill(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(counts[x] // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * times
        out.append((used, times))


def token_pieces(docs: DataFrame, window: int = WINDOW, end_id: int = 0, files: tuple[str, str] | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and `ids` of every piece; ids, little-endian, are there for
    remainders that may be cut further, or for all pieces if asked."""
    files = files or default_files()

    def run(batches):
        encode = encoder(*files)
        for whole in batches:
            for batch in slices(whole):
                row, start, length, crc, total, ids = [], [], [], [], [], []
                for i, text in enumerate(pc.fill_null(batch.column("text"), "").to_pylist()):
                    tokens = array("I", encode(text))
                    tokens.append(end_id)
                    raw, n = np.frombuffer(tokens, np.uint32).astype("<u4", copy=False).tobytes(), len(tokens)
                    for a in range(0, n, window):
                        piece = raw[4 * a : 4 * (a + window)]
                        row.append(i)
                        start.append(a)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        loose = len(piece) < 4 * window and crc[-1] % LOOSE == 0
                        ids.append(piece if with_ids or loose else None)
                parts = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
                yield pa.RecordBatch.from_arrays([*parts, pa.array(ids, pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])

    return columns(docs, doc_id="bigint", text="string").mapInArrow(run, PIECE)


def place(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of a block, and how far each sequence is filled."""
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    whole = np.flatnonzero(lengths == window)
    seq[whole] = np.arange(len(whole))
    rest = np.flatnonzero(lengths < window)
    rest = rest[np.argsort(lengths[rest], kind="stable")]
    counts = np.bincount(lengths[rest], minlength=window)
    first = np.cumsum(counts) - counts  # where a length's rows begin in `rest`
    following = len(whole)
    for used, times in fill_windows(counts.tolist(), window):
        numbers, at = following + np.arange(times), 0
        for x in sorted(used, reverse=True):
            for _ in range(used[x]):
                rows = rest[first[x] : first[x] + times]
                first[x] += times
                seq[rows], offset[rows] = numbers, at
                at += x
        following += times
    return seq, offset, np.bincount(seq, lengths, minlength=following).astype(np.int64)


def pour(lengths: np.ndarray, fills: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Cuts pieces so that they fill the open sequences and then sequences of their own without gaps:
    (piece, begin in it, length, sequence, offset)."""
    room = [(int(s), int(fills[s])) for s in np.flatnonzero(fills < window)]
    out, following = [], len(fills)
    number, at = room.pop(0) if room else (following, 0)
    following += number == following
    for piece, length in enumerate(lengths.tolist()):
        begin = 0
        while begin < length:
            if at == window:
                number, at = room.pop(0) if room else (following, 0)
                following += number == following
            n = min(length - begin, window - at)
            out.append((piece, begin, n, number, at))
            begin, at = begin + n, at + n
    return out


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = 0, files: tuple[str, str] | None = None, block_docs: int = 4096, with_ids: bool = False) -> DataFrame:
    """Every piece of every row with its sequence and its offset there."""
    n_blocks = pieces(docs.count(), block_docs)
    cut = token_pieces(docs, window, end_id, files, with_ids)
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_blocks)).cast("bigint"))

    def one(block: pa.Table) -> pa.Table:
        block = block.sort_by([(c, "ascending") for c in ("doc_id", "start", "ids_crc32", "doc_tokens")])
        lengths, crc = block["length"].to_numpy(), block["ids_crc32"].to_numpy()
        is_loose = (lengths < window) & (crc % LOOSE == 0)
        base = block["block"][0].as_py() << 32
        firm, loose = block.filter(pa.array(~is_loose)), block.filter(pa.array(is_loose))
        seq, offset, fills = place(firm["length"].to_numpy(), window)
        poured = pour(loose["length"].to_numpy(), fills, window)
        ids = loose["ids"].to_pylist()
        slices_ = [ids[i][4 * a : 4 * (a + n)] for i, a, n, _, _ in poured]
        source = loose.take(pa.array([p[0] for p in poured], pa.int64()))
        begin = pa.array([p[1] for p in poured], pa.int64())
        parts = pa.table({
            "doc_id": source["doc_id"], "start": pc.add(source["start"], begin), "length": pa.array([p[2] for p in poured], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x) for x in slices_], pa.int64()), "doc_tokens": source["doc_tokens"], "ids": pa.array(slices_, pa.binary()),
            "sequence_id": pa.array([base + p[3] for p in poured], pa.int64()), "offset": pa.array([p[4] for p in poured], pa.int64()),
        })
        rest = firm.drop_columns(["block"]).append_column("sequence_id", pa.array(base + seq)).append_column("offset", pa.array(offset))
        out = pa.concat_tables([rest, parts.cast(rest.schema)])
        return out if with_ids else out.drop_columns(["ids"])

    shape = PIECE + ", sequence_id bigint, offset bigint"
    return dealt.groupBy("block").applyInArrow(one, shape if with_ids else shape.replace(", ids binary", ""))
