"""Shared pieces of the operators: inputs, shared scratch tables, Arrow text buffers.

Scratch tables go under the folder that the session names in ``spark.checkpoint.dir``, which all executors and the driver
share; where it is unset, only a local master is served.  They last as long as the results that read them;
`ledgerframe.functions.ordinals.drop_scratch` deletes them at the end of a job.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordinals import shared_folder as shared_dir

#: Text handled at once inside a task: its arrays stay near the processor.
SLICE_BYTES = 1 << 19

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of `[^\x20\x09-\x0D]`: works on UTF-8 as bytes of longer characters are 0x80 and above.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after A-Z became a-z.
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[0x30:0x3A] = WORD_BYTE[0x61:0x7B] = WORD_BYTE[0x80:] = True


#: Settings of worker processes by which freed memory isn't held for later.
GIVE_BACK = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2"}


def on_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers started on this machine import the package wherever the driver was started.
    On a cluster the package is deployed with the job (--py-files or the image)."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (known, root) if x)
    # workers live on between stages, so what a stage has freed goes back to the machine
    spark.sparkContext.environment.update(GIVE_BACK)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to the shared folder and read again: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerframe/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def columns(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast, in this order; a column that `df` lacks becomes null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until `df` has no such column (whatever the case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


#: Bits of a hash set that travels to every task: 8 MB, whatever it is made of.
SET_BITS = 26


def hash_set(hashes: DataFrame, name: str) -> DataFrame:
    """A bounded set of 64-bit hashes as rows of 32,768 bits."""
    bit = F.pmod(F.col(name), F.lit(1 << SET_BITS)) + 1
    return hashes.groupBy(F.bitmap_bucket_number(bit).alias("bucket__")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits__"))


def maybe_in(rows: DataFrame, name: str, found: DataFrame, flag: str) -> DataFrame:
    """`rows` with `flag`: false where the hash `name` is surely not in `found` (of hash_set), so that rows that can't
    match need not be shuffled to learn so.  A set of very many hashes says true more often, which costs and harms
    nothing."""
    bit = F.pmod(F.col(f"`{name}`"), F.lit(1 << SET_BITS)) + 1
    at = F.bitmap_bit_position(bit)
    joined = rows.join(F.broadcast(found), F.bitmap_bucket_number(bit) == F.col("bucket__"), "left")  # at most 2 ** (SET_BITS - 15) rows
    byte = F.conv(F.hex(F.substring("bits__", F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.getbit(byte, at.cast("int").bitwiseAND(7)) == 1
    return joined.withColumn(flag, F.coalesce(inside, F.lit(False))).drop("bucket__", "bits__")


def pieces(total: int, each: int) -> int:
    """Number of blocks of about `each` that hold `total`."""
    return max(1, -(-int(total) // each))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins (one longer)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` bytes of text; a longer text stands alone."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    run = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def word_runs(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of bytes for which `is_word` holds, and how many runs begin in each
    text; runs never cross texts."""
    n = len(data)
    flags = np.zeros(n + 1, dtype=np.int8)
    flags[:n] = is_word[data]
    begin = flags[:n].astype(bool)
    begin[1:] &= flags[: n - 1] == 0 if n else True
    inner = at[1:-1]
    inner = inner[inner < n]
    begin[inner] = flags[inner] == 1
    starts = np.flatnonzero(begin)
    stop = flags[:n].astype(bool)
    stop[: n - 1] &= (flags[1:n] == 0) if n else True
    last = inner[inner > 0] - 1
    stop[last] = flags[last] == 1
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.diff(np.searchsorted(starts, at))


_WEIGHTS = np.random.default_rng(20240601).integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def position_weights(longest: int) -> np.ndarray:
    """Odd 64-bit weights for byte places of a word, the same ones at every call."""
    global _WEIGHTS
    while len(_WEIGHTS) < longest:
        more = np.random.default_rng(len(_WEIGHTS)).integers(1, 2**63, len(_WEIGHTS), dtype=np.uint64)
        _WEIGHTS = np.concatenate([_WEIGHTS, more * np.uint64(2) + np.uint64(1)])
    return _WEIGHTS


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit multilinear hash of data[start:end] for each run; runs ascend and don't overlap."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    size = ends - starts
    w = position_weights(int(size.max()))
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    values = (data[np.repeat(starts, size) + place].astype(np.uint64) + np.uint64(1)) * w[place]
    return mix(np.add.reduceat(values, first) + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def crc_of_id(df_column):
    """crc32 of the id as decimal text; a null id counts as empty text."""
    return F.crc32(F.coalesce(df_column.cast("string"), F.lit("")).cast("binary"))
