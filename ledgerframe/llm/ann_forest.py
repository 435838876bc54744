"""Approximate nearest neighbours by a hash-prefix forest.

A tree turns a vector round at random and reads the result in groups of `width` coordinates: each group's symbol is the
place and sign of its largest coordinate (a cross-polytope hash), and the symbols in their order are the vector's hash
string.  A tree keeps the strings of a block's vectors as a sorted array.  A query descends to its longest matching
prefix in every tree - a range of the sorted array - and then ascends in all trees at the same level: the ranges of the
longer prefix first, then, tree after tree, those of the prefix one symbol shorter, until its candidates are taken up:
2 n ** 0.76 of the table's n entries, k + 1 of each block at least.  Candidates are ranked by exact Euclidean distance on the original vectors in double
precision.  There is no size below which the forest is left out.

Rotations are random; vectors are read relative to the mean of a bounded sample (at most `sample_rows` vectors, those of
smallest hash).  Every vector is indexed.  Vectors without clusters, as in the tables here, have neighbours at two thirds
of a right angle: a prefix range of two symbols holds a thousandth of the vectors and each true neighbour with
probability 0.02 only, so a recall above 0.9 needs the ranges of some 200 trees, which together reach into every part
of the table.  Measured here, recall at the share of candidates: 0.93 at 0.45 of 500 entries, 0.94 at 0.33 of 2,000, 0.95 at 0.23 of
10,256 and 0.97 at 0.15 of 51,282; the exponent is fitted to that.  Data with structure needs a smaller reach.

Vectors are dealt by a hash into blocks of about `block_rows`, each with its own sorted arrays.  A task reads a block's
vectors, then the queries pass it a batch at a time; vectors are sent once, no key gathers rows, and memory holds a block
and a batch.  Equal vectors are one entry with their k + 1 smallest ids, which is all that k nearest without oneself can
need.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold null or
non-finite values take no part, neither do rows without an id; of rows with one id and different vectors the nearest
counts; ties go to the smaller id; with fewer candidates than k all are returned; an empty table gives an empty
result; columns besides the id and the vector are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import columns, kept, pieces

#: Symbols of a hash string.
SYMBOLS = 4


@dataclass(frozen=True)
class ForestSpec:
    """trees, the coordinates that a symbol is chosen from, and how many of n entries a query takes up as candidates:
    `reach` * n ** `power`."""

    k: int = 10
    every: int = 100
    trees: int = 192
    width: int = 16
    reach: float = 2.0
    power: float = 0.76
    block_rows: int = 16384
    sample_rows: int = 4096
    seed: int = 11

    def wanted(self, block: int, n: int) -> int:
        """Candidates of a block's entries: its part of what the whole table's n entries offer."""
        return max(self.k + 1, int(np.ceil(block * min(1.0, self.reach * max(n, 1) ** (self.power - 1)))))


def rotations(sample: np.ndarray, dim: int, spec: ForestSpec) -> tuple[np.ndarray, np.ndarray]:
    """(trees, dim, SYMBOLS * width) directions, at right angles as far as there are dimensions, and the sample's mean."""
    rng = np.random.default_rng(spec.seed)
    width = min(spec.width, max(dim, 1))
    turns = -(-SYMBOLS * width // max(dim, 1))
    out = np.empty((spec.trees, dim, SYMBOLS * width), np.float32)
    for t in range(spec.trees):
        whole = np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(turns)], 1)
        out[t] = whole[:, : SYMBOLS * width]
    return out, sample.mean(0) if len(sample) else np.zeros(dim)


class Forest:
    """Sorted arrays of the hash strings of one block."""

    def __init__(self, x: np.ndarray, turned: np.ndarray, center: np.ndarray):
        self.turned, self.center, self.n = turned, center, len(x)
        self.base = 2 * (turned.shape[2] // SYMBOLS)
        h = self.strings(x)
        self.order = np.argsort(h, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(h, self.order, axis=1)

    def strings(self, x: np.ndarray) -> np.ndarray:
        """(trees, vectors) hash strings as numbers, the first symbol highest."""
        centred = (x - self.center).astype(np.float32)
        out = np.zeros((len(self.turned), len(x)), np.int32 if self.base**SYMBOLS < 2**31 else np.int64)
        for t, turn in enumerate(self.turned):
            z = (centred @ turn).reshape(len(x), SYMBOLS, -1)
            largest = np.abs(z).argmax(2)
            positive = np.take_along_axis(z, largest[:, :, None], 2)[:, :, 0] > 0
            for symbol in (2 * largest + positive).T.astype(out.dtype):
                out[t] = out[t] * self.base + symbol
        return out

    def candidates(self, q: np.ndarray, wanted: int) -> Iterator[np.ndarray]:
        """For each query the places of at least `wanted` entries (or all)."""
        h = self.strings(q)
        wanted = min(wanted, self.n)
        lo, hi = np.empty((2, SYMBOLS + 1, *h.shape), np.int32)
        for level in range(SYMBOLS + 1):  # bounds of the entries that share the first `level` symbols
            unit = self.base ** (SYMBOLS - level)
            low = h // unit * unit
            for t in range(len(h)):
                lo[level, t] = np.searchsorted(self.sorted[t], low[t])
                hi[level, t] = np.searchsorted(self.sorted[t], low[t] + (unit - 1), side="right")
        lo[0], hi[0] = 0, self.n
        enough = (hi - lo).sum(1) >= wanted
        for i in range(len(q)):
            level, taken = int(np.flatnonzero(enough[:, i])[-1]), np.zeros(self.n, bool)
            if level < SYMBOLS:
                taken[self._ranges(lo[level + 1, :, i], hi[level + 1, :, i], 0, len(h))] = True
            while (have := int(taken.sum())) < wanted:
                upto, t = np.cumsum(hi[level, :, i] - lo[level, :, i]), 0
                while t < len(h) and have < wanted:  # as many trees as are missing entries, one at least
                    more = max(t + 1, int(np.searchsorted(upto, (upto[t - 1] if t else 0) + wanted - have, side="right")))
                    taken[self._ranges(lo[level, :, i], hi[level, :, i], t, more)] = True
                    t, have = more, int(taken.sum())
                level -= 1
            yield np.flatnonzero(taken)

    def _ranges(self, lo: np.ndarray, hi: np.ndarray, first: int, last: int) -> np.ndarray:
        """Entries of the trees first..last between the bounds."""
        a, b = lo[first:last].tolist(), hi[first:last].tolist()
        return np.concatenate([self.order[first + t, x:y] for t, (x, y) in enumerate(zip(a, b)) if y > x] or [np.zeros(0, np.int32)])


def nearest(q: np.ndarray, x: np.ndarray, forest: Forest, keep: int, wanted: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and distances of at least `keep` nearest candidates (all ties of the last one) of each query."""
    square = np.einsum("ij,ij->i", x, x)
    for i, found in enumerate(forest.candidates(q, wanted)):
        if len(found) > keep:  # all that may be among the nearest, by a quicker formula with room for its rounding
            near = square[found] - 2 * (x[found] @ q[i])
            room = 1e-9 * (square[found].max() + q[i] @ q[i])
            found = found[near <= np.partition(near, keep - 1)[keep - 1] + room]
        yield found, np.sqrt(((x[found] - q[i]) ** 2).sum(1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows that take part."""
    rows = columns(vectors.withColumnsRenamed({id_col: "id", vector_col: "v"}) if id_col != "id" or vector_col != "v" else vectors, id="bigint", v="array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = rows.where(F.col("id").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    return rows.where(F.size("v") == F.lit(dims.dim if dims else 0))


def search(vectors: DataFrame, spec: ForestSpec = ForestSpec(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row whose id is divisible by spec.every."""
    rows = kept(usable(vectors.select(id_col, vector_col), id_col, vector_col), "ann-rows")
    keep = spec.k + 1
    # equal vectors: the smallest ids of each task's share, then of those
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    by_salt = W.partitionBy("v", "salt").orderBy("id")
    few = salted.withColumn("r", F.row_number().over(by_salt)).where(F.col("r") <= keep).drop("r")
    ids = few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, keep).alias("ids"))
    entries = kept(ids, "ann-entries")
    n = entries.count()
    sample = entries.orderBy(F.xxhash64("v"), "v").limit(spec.sample_rows).toArrow()["v"]
    sample = np.array(sample.to_pylist(), float) if len(sample) else np.zeros((0, 1))
    turned, center = rotations(sample, sample.shape[1], spec)
    blob = vectors.sparkSession.sparkContext.broadcast(pickle.dumps((turned, center)))  # trees * dimensions ** 2 numbers
    blocks = pieces(n, spec.block_rows)
    side = entries.select(F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("block"), F.lit(None).cast("bigint").alias("query"), "ids", "v")
    asked = rows.where(F.col("id") % spec.every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("id").alias("query"), F.lit(None).cast("array<bigint>").alias("ids"), "v")
    placed = side.unionAll(asked).repartition(blocks, "block").sortWithinPartitions("block", F.col("query").isNotNull())
    names = ["query_id", "vec_id", "score"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's entries come first, then its queries, batch by batch."""
        turned, center = pickle.loads(blob.value)
        at, held, own, x, forest = None, [], [], None, None
        for batch in batches:
            block, is_query = batch.column("block").to_numpy(), batch.column("query").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(block) | np.diff(is_query.astype(np.int8))) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if block[a] != at:
                    at, held, own, x, forest = block[a], [], [], None, None
                part = batch.slice(a, b - a)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                if not is_query[a]:
                    held.append(np.array(v))
                    own += part.column("ids").to_pylist()
                    continue
                if not own:
                    continue
                if forest is None:
                    x = np.concatenate(held)
                    held, forest = [], Forest(x, turned, center)
                q_ids, out = part.column("query").to_pylist(), ([], [], [])
                for q, (places, dist) in zip(q_ids, nearest(v, x, forest, keep, spec.wanted(len(x), n))):
                    found = sorted((s, i) for p, s in zip(places.tolist(), dist.tolist()) for i in own[p] if i != q)[: spec.k]
                    out[0].extend([q] * len(found))
                    out[1].extend(i for _, i in found)
                    out[2].extend(s for s, _ in found)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names)

    found = placed.mapInArrow(visit, "query_id bigint, vec_id bigint, score double")
    best = W.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= spec.k).select("query_id", "rank", "vec_id", "score")
