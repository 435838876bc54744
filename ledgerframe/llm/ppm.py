"""Language-model scoring by prediction by partial matching over bytes.

The pretrained model is a trie of byte contexts up to `order` bytes with the counts of what followed them.  A
byte is coded at the longest context that was seen; if it never followed there, an escape is coded and the next
shorter context is tried, with all bytes that followed the longer one excluded, down to a uniform choice.
Escapes are estimated from the training texts: each of their bytes, left out of the counts, is coded or escaped
at contexts of so many counts and different bytes.

Before that, the model adapts to the text itself: where the seven bytes before a byte stood earlier in the same
text, the byte that followed them there (the last time) is foretold, and once `least_run` foretellings in a row came
true it is coded first, with an escape estimated from the training texts by the length of the run; after that
escape the byte is excluded below.  This prices repeated lines and passages.  A text's score is the log10 probability of its bytes (A-Z lower) and an end mark.

A probability depends only on the window of `order` bytes and the byte itself, so nothing needs the whole trie:

* each task counts the distinct windows of its texts, and counts are merged by shard, a hash of the three bytes
  before the predicted one, so that a shard holds every longer context of its windows;
* shards are as many as blocks, without a cap: windows of one shard share three bytes, so a shard has at most 2**24
  different ones for each such context however large the corpus, and a block asks as many shards as it has contexts;
* contexts of up to two bytes are at most 2**24 counts, the only thing that is broadcast;
* texts are dealt into blocks of about `block_chars`; a block's distinct windows go to their shards, their log
  probabilities come back in that order, and the block sums them up by text.

Word counts of the unigram base take the same way, by 64-bit hashes of the words.  What is shuffled grows with the
distinct windows and words of tasks and blocks; there is no row for a byte or a token.

Defined results: a null text is an empty one, coded as the end mark alone; repeated rows are scored each by
itself; null ids count as empty text for the split; without any training row every byte is a uniform choice and
the base is log10(0.5/0.5) a token; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, columns, crc_of_id, kept, mix, pieces, run_hashes, slices, text_buffer, word_runs

#: Bytes that UTF-8 never uses stand before a text and at its end.
BEGIN, END = 0xFE, 0xFF
#: Contexts of up to LOW bytes are kept whole by everyone; shards are dealt by LOW + 1 bytes.
LOW = 2
#: Key of the end of a text among word hashes.
END_WORD = np.uint64(0x0E0D0E0D0E0D0E0D)

WINDOWS, WORDS, REPEATS = 0, 1, 2

#: Bytes or keys handled at once, so that arrays of them stay near the processor.
SLICE, NEAR = 1 << 19, 1 << 16


@dataclass(frozen=True)
class PpmSpec:
    order: int = 5
    least_run: int = 4
    block_chars: int = 6_000_000
    merge: int = 64


def u64(x: int) -> np.uint64:
    return np.uint64(x)


def windows(column: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The window that ends in each byte (and end mark) of the texts, and how many each text has."""
    raw, at = text_buffer(column)
    low = LOWER[raw]
    size = np.diff(at)
    each = size + order + 1
    base = np.cumsum(each) - each
    n = int(each.sum())
    buf = np.full(n + 8, BEGIN, np.uint8)
    for a, b, c in zip(at[:-1].tolist(), at[1:].tolist(), (base + order).tolist()):
        buf[c : c + b - a] = low[a:b]
    buf[base + each - 1] = END
    mine = np.ones(n, bool)  # windows that end in the mark before a text belong to nobody
    mine[(base[:, None] + np.arange(order)).ravel()] = False
    every = np.ndarray((max(n - order, 0),), ">u8", buf, strides=(1,)).astype(np.uint64) >> u64(8 * (7 - order))
    return every[mine[order:]], size + 1


#: Bytes before a byte that must have stood earlier in the text, and levels of run lengths.
FAR, RUNS = 7, 13


def repeats(column: pa.Array, least_run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Where a byte is foretold within its text: place among the windows, the byte foretold, whether it came true,
    and the level of the run of true ones before it; and the number of windows."""
    w, n = windows(column, FAR)
    row, context, symbol = np.repeat(np.arange(len(n)), n), w >> u64(8), (w & u64(255)).astype(np.int64)
    before = last_places(context, row)
    told = np.where(before >= 0, symbol[before], -1)
    true = told == symbol
    place = np.arange(len(w))
    start = np.cumsum(n) - n
    reset = np.where(true, -1, place + 1)  # a run begins after the last miss, or with the text
    reset[start] = np.maximum(reset[start], start)
    run = np.zeros(len(w), np.int64)
    run[1:] = place[1:] - np.maximum.accumulate(reset)[:-1]
    run[start] = 0
    use = np.flatnonzero((before >= 0) & (run >= least_run))
    return use, told[use], true[use], np.minimum(np.rint(2 * np.log2(np.maximum(run[use], 1))), RUNS - 1).astype(np.int64), len(w)


def last_places(context: np.ndarray, row: np.ndarray) -> np.ndarray:
    """For each place the last one before it with its context in its text, or -1.  Places are sorted by 40 bits of a
    hash, place last; groups in which contexts differ are sorted anew by all."""
    n = len(context)
    h = (context * u64(0x9E3779B97F4A7C15) + row.astype(np.uint64)) * u64(0xC2B2AE3D27D4EB4F)
    if n >= 1 << 24:
        order = np.lexsort((context, row))
        c, r = context[order], row[order]
        same = (c[1:] == c[:-1]) & (r[1:] == r[:-1])
    else:
        key = np.sort((h & ~u64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64))
        order, group = (key & u64((1 << 24) - 1)).astype(np.int64), key >> u64(24)
        c, r = context[order], row[order]
        same = (c[1:] == c[:-1]) & (r[1:] == r[:-1])
        clash = np.flatnonzero((group[1:] == group[:-1]) & ~same)
        if len(clash):
            mixed = np.flatnonzero(np.isin(group, group[clash]))
            own = order[mixed]
            order[mixed] = own[np.lexsort((own, context[own], row[own], group[mixed]))]
            c, r = context[order], row[order]
            same = (c[1:] == c[:-1]) & (r[1:] == r[:-1])
    out, at = np.full(n, -1, np.int64), np.flatnonzero(same)
    out[order[at + 1]] = order[at]
    return out


def word_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and how many words each text has."""
    raw, at = text_buffer(column)
    data = LOWER[raw]
    starts, ends, n = word_runs(data, at, NOT_SPACE)
    return run_hashes(data, starts, ends), n.astype(np.int64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(k) else c


def planes(x: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, as whole planes of zeros compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    n = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(n, -1).T).view(kind).ravel()


def steps(keys: np.ndarray) -> bytes:
    """Ascending keys as their differences."""
    return planes(np.diff(keys, prepend=u64(0)))


def from_steps(raw: bytes) -> np.ndarray:
    return np.cumsum(from_planes(raw, np.uint64), dtype=np.uint64)


def shard_of(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    part = (keys >> u64(8)) & u64((1 << 8 * (LOW + 1)) - 1) if kind == WINDOWS else keys
    return (mix(part) % u64(shards)).astype(np.int64)


_ROW = "kind int, shard int, part bigint, keys binary, counts binary"


def _rows(kind: int, part: int, keys: np.ndarray, counts: np.ndarray, shards: int):
    """A row for each shard that has keys."""
    shard = shard_of(kind, keys, shards)
    order = np.argsort(shard, kind="stable")
    shard, keys, counts = shard[order], keys[order], counts[order]
    cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else [0]
    for a, b in zip(cut[:-1], cut[1:]):
        yield kind, int(shard[a]), part, steps(keys[a:b]), planes(counts[a:b])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kind, shard, part, keys, counts = zip(*rows) if rows else ([],) * 5
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(shard, pa.int32()), pa.array(part, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["kind", "shard", "part", "keys", "counts"])


def trained(docs: DataFrame, spec: PpmSpec, shards: int) -> DataFrame:
    """(kind, shard, keys, counts): windows and words of all training rows, a row for each kind and shard."""

    def count(batches):
        from pyspark import TaskContext

        held = {WINDOWS: ([], []), WORDS: ([], [])}
        runs = np.zeros((RUNS, 2), np.int64)
        part = TaskContext.get().partitionId()

        def fold(kind: int) -> None:
            held[kind] = tuple([x] for x in merged(*held[kind]))

        for whole in batches:
            for batch in slices(whole, most=SLICE):
                keys, _ = windows(batch.column("text"), spec.order)
                words, _ = word_keys(batch.column("text"))
                for kind, k in ((WINDOWS, keys), (WORDS, words)):
                    u, c = distinct(k)
                    held[kind][0].append(u)
                    held[kind][1].append(c)
                held[WORDS][0].append(np.array([END_WORD]))
                held[WORDS][1].append(np.array([batch.num_rows], np.int64))
                for part_ in slices(batch, most=NEAR):
                    _, _, true, level_, _ = repeats(part_.column("text"), spec.least_run)
                    np.add.at(runs, (level_, true.astype(np.int64)), 1)
                for kind in held:
                    if len(held[kind][0]) > 24:
                        fold(kind)
        for kind in held:
            if held[kind][0]:
                fold(kind)
                rows = list(_rows(kind, part, held[kind][0][0], held[kind][1][0], shards))
                for i in range(0, len(rows), 64):
                    yield _batch(rows[i : i + 64])
        yield _batch([(REPEATS, 0, part, b"", planes(runs.ravel()))])

    def merge(rows: pa.Table) -> pa.Table:
        if rows["kind"][0].as_py() == REPEATS:
            runs = sum(from_planes(x, np.int64) for x in rows["counts"].to_pylist())
            head = rows.slice(0, 1)
            return head.set_column(head.schema.get_field_index("counts"), "counts", pa.array([planes(runs)], pa.binary()))
        k, c = merged([from_steps(x) for x in rows["keys"].to_pylist()], [from_planes(x, np.int64) for x in rows["counts"].to_pylist()])
        head = rows.slice(0, 1)
        return pa.table({"kind": head["kind"], "shard": head["shard"], "part": head["part"], "keys": pa.array([steps(k)], pa.binary()), "counts": pa.array([planes(c)], pa.binary())})

    found = docs.select("text").mapInArrow(count, _ROW)
    tasks = docs.rdd.getNumPartitions()
    while tasks > 1:  # a task merges the parts of at most spec.merge tasks
        tasks = pieces(tasks, spec.merge)
        found = found.withColumn("part", F.pmod(F.col("part"), F.lit(tasks))).groupBy("kind", "shard", "part").applyInArrow(merge, _ROW)
    return found.select("kind", "shard", "keys", "counts")


def low_counts(trie: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the windows of LOW + 1 bytes over the corpus: at most 2**24."""

    def low(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                k, c = merged([from_steps(keys) & u64((1 << 8 * (LOW + 1)) - 1)], [from_planes(counts, np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(c)], ["k", "c"])

    sums = trie.where(F.col("kind") == WINDOWS).select("keys", "counts").mapInArrow(low, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c")).toArrow()
    k, c = sums["k"].to_numpy().astype(np.uint64), sums["c"].to_numpy().astype(np.int64)
    order = np.argsort(k)
    return k[order], c[order]


def found_in(names: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each x in the ascending names."""
    if not len(names):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(names, x), len(names) - 1)
    return at, names[at] == x


def counted_level(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """(keys, counts, contexts, n, t) of the windows of one order."""
    ctx = k >> u64(8)
    first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, np.int64)
    return k, c, ctx[first], np.add.reduceat(c, first) if len(c) else c, np.diff(np.append(first, len(ctx)))


def shorter_counts(j: int, level: tuple[np.ndarray, ...], keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each context of order j the counts that its bytes have in the context one byte shorter, whose windows are
    given."""
    k, _, ctx = level[:3]
    at, there = found_in(keys, k & u64((1 << 8 * j) - 1))
    c = np.where(there, counts[at] if len(counts) else 0, 0)
    return np.add.reduceat(c, np.searchsorted(k >> u64(8), ctx)) if len(c) else c


_short: list = [None, 0, None]


def short_levels(low: tuple[np.ndarray, np.ndarray], upto: int) -> tuple[dict, ...]:
    """Orders 0 to `upto` of the corpus's short windows, built once for the table that a process holds."""
    if _short[0] is not low or _short[1] != upto:
        out: tuple[dict, ...] = ({}, {}, {}, {}, {}, {})
        for j in range(upto + 1):
            level = counted_level(*merged([low[0] & u64((1 << 8 * (j + 1)) - 1)], [low[1]]))
            for d, x in zip(out, level):
                d[j] = x
            out[5][j] = shorter_counts(j, level, out[0][j - 1], out[1][j - 1]) if j else np.zeros(len(level[2]), np.int64)
        _short[:] = [low, upto, out]
    return _short[2]


class Trie:
    """Contexts of every order with what coding needs: n counts and t different bytes after a context, and
    `out`, the counts that those t bytes have in the context one byte shorter."""

    def __init__(self, order: int, keys: np.ndarray, counts: np.ndarray, low: tuple[np.ndarray, np.ndarray]):
        """keys, counts: windows of all longer contexts that share a shard; low: of the shortest, of the corpus."""
        self.order = order
        short = short_levels(low, min(order, LOW))
        self.keys, self.counts, self.ctx, self.n, self.t, self.out = (dict(x) for x in short)
        for j in range(LOW + 1, order + 1):
            level = counted_level(*merged([keys & u64((1 << 8 * (j + 1)) - 1)], [counts]))
            self.keys[j], self.counts[j], self.ctx[j], self.n[j], self.t[j] = level
            self.out[j] = shorter_counts(j, level, self.keys[j - 1], self.counts[j - 1])

    def walk(self, q: np.ndarray, without: np.ndarray | None = None):
        """The coding steps of each window's last byte, from the longest seen context down: (order, rows, after,
        n, t, c) where `after` says whether a longer context was escaped from, n and t are the counts and the
        different bytes that aren't excluded, and c is the byte's count, 0 for an escape.  Rows that no context
        codes come last, with order -1 and t the number of excluded bytes.

        without: the windows' own counts, where a step is to be told as it is without the occurrence itself.
        """
        one = 0 if without is None else 1
        todo = np.ones(len(q), bool)
        after = np.zeros(len(q), bool)
        gone, kinds = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)  # excluded counts and bytes
        for j in range(self.order, -1, -1):
            if not len(self.ctx[j]):
                continue
            rows = np.flatnonzero(todo)
            at, there = found_in(self.ctx[j], (q[rows] >> u64(8)) & u64((1 << 8 * j) - 1))
            there &= self.n[j][at] > one  # without itself the context may be new
            rows, at = rows[there], at[there]
            where, hit = found_in(self.keys[j], q[rows] & u64((1 << 8 * (j + 1)) - 1))
            c = np.where(hit, self.counts[j][where], 0) - one
            alone = (c == 0) & bool(one)
            n, t = self.n[j][at] - one - gone[rows], self.t[j][at] - alone - kinds[rows]
            yield j, rows, after[rows], n, t, c
            todo[rows[c > 0]] = False
            # what the longer context excludes further down: its bytes, and their counts there
            gone[rows], kinds[rows], after[rows] = self.out[j][at], self.t[j][at] - alone, True
            if one and j:
                below, has = found_in(self.keys[j - 1], q[rows] & u64((1 << 8 * j) - 1))
                gone[rows] -= np.where(alone & has, self.counts[j - 1][below], 0)
        rows = np.flatnonzero(todo)
        zero = np.zeros(len(rows), np.int64)
        yield -1, rows, after[rows], zero, kinds[rows], zero

    def log10(self, q: np.ndarray, escapes: np.ndarray) -> np.ndarray:
        """Log probability of the last byte of each window after the bytes before it."""
        logp = np.zeros(len(q))
        for j, rows, after, n, t, c in self.walk(q):
            if j < 0:
                logp[rows] -= np.log10(np.maximum(256 - t, 1))
                continue
            some = n > 0  # all that followed may be excluded: then the escape is certain
            rows, after, n, t, c = rows[some], after[some], n[some], t[some], c[some]
            e = escapes[j, after.astype(np.int64), level(n), level(t)]
            hit = c > 0
            logp[rows[~hit]] += np.log10(e[~hit])
            logp[rows[hit]] += np.log10((1 - e[hit]) * c[hit] / n[hit])
        return logp

    def tally(self, q: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often training bytes, each left out of the counts, were coded and escaped: (order, after a longer
        context or not, level of n, level of t, coded or escaped)."""
        out = np.zeros((self.order + 1, 2, LEVELS, LEVELS, 2))
        for j, rows, after, n, t, c in self.walk(q, counts):
            if j >= 0:
                some = n > 0
                np.add.at(out, (j, after[some].astype(np.int64), level(n[some]), level(t[some]), (c[some] <= 0).astype(np.int64)), counts[rows[some]])
        return out


#: Numbers are told apart by half powers of two up to this many levels.
LEVELS = 32


def level(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(2 * np.log2(np.maximum(x, 1))).astype(np.int64), LEVELS - 1)


def escape_table(tally: np.ndarray) -> np.ndarray:
    """Escape probabilities from the tally, drawn towards method D (t / 2n) where little was seen."""
    mid = 2.0 ** (np.arange(LEVELS) / 2)
    prior = np.clip(mid[None, :] / (2 * mid[:, None]), 0.001, 0.9)
    return np.clip((tally[..., 1] + 4 * prior) / (tally.sum(-1) + 4), 1e-6, 1 - 1e-6)


class Lookup:
    """Values by 64-bit key: a table of slots, each a key beside its value, and a search for the few keys that share
    one."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        """keys ascend."""
        self.keys, self.values = keys, values
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = u64(64 - bits)
        self.slots = np.zeros((1 << bits, 2), np.uint64)
        s = self.slot(keys)
        self.slots[s, 0], self.slots[s, 1] = ~keys, values.astype(np.float64).view(np.uint64)  # an empty slot has key ~0

    def slot(self, x: np.ndarray) -> np.ndarray:
        return (x * u64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, x: np.ndarray) -> np.ndarray:
        found = np.take(self.slots, self.slot(x), axis=0)
        out = found[:, 1].copy().view(np.float64)
        rest = np.flatnonzero(found[:, 0] != ~x)
        out[rest] = self.values[np.searchsorted(self.keys, x[rest])]
        return out


def run_escapes(counts: list[bytes]) -> np.ndarray:
    """Escape probabilities of foretold bytes by run level; a merged tally is one row."""
    runs = np.zeros((RUNS, 2), np.int64) + sum(from_planes(bytes(x), np.int64).reshape(RUNS, 2) for x in counts)
    return (runs[:, 0] + 1) / (runs.sum(1) + 2)


def escape_counts(trie: DataFrame, low, order: int) -> np.ndarray:
    """The tally of all shards; its size is fixed by order and LEVELS."""

    def tell(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                k, c = from_steps(keys), from_planes(counts, np.int64)
                cells = Trie(order, k, c, low.value).tally(k, c).ravel()
                at = np.flatnonzero(cells)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at].astype(np.int64))], ["cell", "n"])

    rows = trie.where(F.col("kind") == WINDOWS).select("keys", "counts").mapInArrow(tell, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((order + 1) * 2 * LEVELS * LEVELS * 2)
    out[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return out.reshape(order + 1, 2, LEVELS, LEVELS, 2)


def sums(look: "Lookup", keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of the keys' values for each text of so many keys, a stretch of keys at a time."""
    out, row = np.zeros(len(counts)), np.cumsum(counts)
    for a in range(0, len(keys), SLICE):
        b = min(a + SLICE, len(keys))
        lo, hi = int(np.searchsorted(row, a, side="right")), int(np.searchsorted(row, b - 1, side="right"))
        first = np.maximum(row[lo : hi + 1] - counts[lo : hi + 1], a) - a
        out[lo : hi + 1] += np.where(counts[lo : hi + 1] > 0, np.add.reduceat(look(keys[a:b]), np.minimum(first, b - a - 1)), 0)
    return out


class Block:
    """Windows and words of a block's texts, and which of them are different."""

    def __init__(self, texts: pa.Table, spec: PpmSpec, shards: int, scoring: bool = False):
        self.n_keys, self.n_words, keys, words, before = [], [], [np.zeros(0, np.uint64)], [np.array([END_WORD])], 0
        told = []
        for whole in texts.to_batches():
            for batch in slices(whole, most=SLICE):
                for found, counts, (k, n) in ((keys, self.n_keys, windows(batch.column("text"), spec.order)), (words, self.n_words, word_keys(batch.column("text")))):
                    found.append(k)
                    counts.append(n)
                if scoring:
                    at = 0
                    for part in slices(batch, most=NEAR):
                        use, byte, true, run, n = repeats(part.column("text"), spec.least_run)
                        told.append((use + at + before, (keys[-1][use + at] & ~u64(255)) | byte.astype(np.uint64), true, run))
                        at += n
                    before += at
        if scoring:
            self.told = [np.concatenate(x) for x in zip(*told)]
        self.keys = {WINDOWS: np.concatenate(keys), WORDS: np.concatenate(words)}
        self.different = {kind: distinct(k)[0] for kind, k in self.keys.items()}
        self.shards = {kind: shard_of(kind, k, shards) for kind, k in self.different.items()}

    def sent(self, kind: int):
        """(shard, keys) of the different ones; a shard's keys ascend."""
        order = np.argsort(self.shards[kind], kind="stable")
        shard, keys = self.shards[kind][order], self.different[kind][order]
        cut = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else [0]
        for a, b in zip(cut[:-1], cut[1:]):
            yield int(shard[a]), keys[a:b]

    def values(self, kind: int, answers: dict[int, np.ndarray]) -> "Lookup":
        """Answers came by shard in the order of what was sent."""
        out = np.zeros(len(self.different[kind]))
        order = np.argsort(self.shards[kind], kind="stable")
        out[order] = np.concatenate([np.zeros(0), *(answers[s] for s in sorted(answers))])
        return Lookup(self.different[kind], out)


def _asked(texts: pa.Table, spec: PpmSpec, shards: int) -> pa.Table:
    block, number = Block(texts, spec, shards), texts["block"][0].as_py()
    rows = [(kind, shard, number, steps(keys)) for kind in (WINDOWS, WORDS) for shard, keys in block.sent(kind)]
    kind, shard, part, keys = zip(*rows)
    return pa.table({"kind": pa.array(kind, pa.int32()), "shard": pa.array(shard, pa.int32()), "part": pa.array(part, pa.int64()), "keys": pa.array(keys, pa.binary())})


def train_side(doc_id):
    return F.pmod(crc_of_id(doc_id), F.lit(5)) != 1


def ppm_scores(docs: DataFrame, spec: PpmSpec = PpmSpec()) -> DataFrame:
    """doc_id, held_out, token counts, and log10 probabilities by the unigram base and by the model."""
    source = columns(docs, doc_id="bigint", text="string")
    size = source.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    blocks = pieces(size, spec.block_chars)
    shards = max(16, blocks)
    trie = kept(trained(source.where(train_side(F.col("doc_id"))), spec, shards), "ppm-trie")
    told = lambda batches: (pa.RecordBatch.from_arrays([pa.array([sum(len(x) // 8 for x in b.column("keys").to_pylist())], pa.int64()), pa.array([int(sum(from_planes(x, np.int64).sum() for x in b.column("counts").to_pylist()))], pa.int64())], ["v", "n"]) for b in batches)
    totals = trie.where(F.col("kind") == WORDS).select("keys", "counts").mapInArrow(told, "v bigint, n bigint").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    v, n_train = int(totals.v or 0), int(totals.n or 0)
    low = docs.sparkSession.sparkContext.broadcast(low_counts(trie))  # at most 2**24 counts; a worker reads them once
    escapes = escape_table(escape_counts(trie, low, spec.order))
    repeat_escapes = run_escapes([r["counts"] for r in trie.where(F.col("kind") == REPEATS).select("counts").collect()])
    dealt = source.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("bigint"))
    asked = dealt.groupBy("block").applyInArrow(lambda rows: _asked(rows, spec, shards), "kind int, shard int, part bigint, keys binary")
    # a call answers at most 2**18 blocks
    lots = (blocks >> 18) + 1
    offered = trie.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))

    def answer(known: pa.Table, rows: pa.Table) -> pa.Table:
        values = []
        if rows.num_rows:
            kind = rows["kind"][0].as_py()
            k, c = (from_steps(known["keys"][0].as_py()), from_planes(known["counts"][0].as_py(), np.int64)) if known.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            model = Trie(spec.order, k, c, low.value) if kind == WINDOWS else None
            for keys in rows["keys"].to_pylist():
                q = from_steps(keys)
                if kind == WINDOWS:
                    values.append(planes(model.log10(q, escapes).astype(np.float32)))
                else:
                    at, there = found_in(k, q)
                    values.append(planes(np.where(there, c[at] if len(c) else 0, 0).astype(np.int64)))
        return pa.table({"block": rows["part"], "kind": rows["kind"], "shard": rows["shard"], "vals": pa.array(values, pa.binary())})

    key = ["kind", "shard", "lot"]
    answered = offered.groupBy(*key).cogroup(asked.withColumn("lot", F.shiftright("part", 18).cast("int")).groupBy(*key)).applyInArrow(answer, "block bigint, kind int, shard int, vals binary")
    scale = np.log10(n_train + 0.5 * (v + 1))

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})
        block, look = Block(texts, spec, shards, scoring=True), {}
        for kind, number in ((WINDOWS, np.float32), (WORDS, np.int64)):
            mine = found.filter(pc.equal(found["kind"], kind))
            look[kind] = block.values(kind, {s: from_planes(v, number) for s, v in zip(mine["shard"].to_pylist(), mine["vals"].to_pylist())})
        n_keys, n_words = np.concatenate(block.n_keys), np.concatenate(block.n_words)
        m = len(n_keys)
        total = sums(look[WINDOWS], block.keys[WINDOWS], n_keys)
        use, foretold, true, run = block.told
        other = look[WINDOWS](block.keys[WINDOWS][use])
        rest = np.log10(np.maximum(1 - 10 ** look[WINDOWS](foretold), 1e-12))
        instead = np.where(true, np.log10(1 - repeat_escapes[run]), np.log10(repeat_escapes[run]) + other - rest)
        total += np.bincount(np.searchsorted(np.cumsum(n_keys), use, side="right"), instead - other, minlength=m)
        c = look[WORDS](block.keys[WORDS])  # the first is the end
        row = np.repeat(np.arange(m), n_words)
        base = np.bincount(row, np.log10(c[1:] + 0.5), minlength=m) + np.log10(c[0] + 0.5) - (n_words + 1) * scale
        n_known = np.bincount(row, c[1:] > 0, minlength=m).astype(np.int64) + int(c[0] > 0)
        return pa.table({"doc_id": texts["doc_id"], "n_tokens": pa.array(n_words + 1), "n_known": pa.array(n_known), "base_score": pa.array(base), "score": pa.array(total)})

    scored = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
    return scored.select("doc_id", (~train_side(F.col("doc_id"))).alias("held_out"), "n_tokens", "n_known", F.lit(n_train).cast("bigint").alias("train_tokens"), "base_score", "score")
