"""Dense numbers and time-ordered ids for rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotConfigured


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session's spark.checkpoint.dir.  Where that is unset one is made on this machine, which only a
    local master shares with its executors; any other is refused."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise NotConfigured("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='ledgerframe-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_staged: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging(spark: SparkSession, failed: Callable[[str, Exception], None] = lambda path, error: None) -> Iterator[None]:
    """What is materialised inside is deleted at the end.  A deletion that fails is told and does no other harm."""
    if _staged.get() is not None:
        yield
        return
    token = _staged.set(paths := [])
    try:
        yield
    finally:
        _staged.reset(token)
        for path in paths:
            try:
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            except Exception as e:  # noqa: BLE001
                failed(path, e)


def materialized(df: DataFrame, name: str = "staged") -> DataFrame:
    """`df` written once to the shared folder and read back: computed once, kept when executors are lost."""
    path = f"{shared_folder(df.sparkSession)}/ledgerframe/{name}-{uuid.uuid4().hex}"
    if _staged.get() is not None:
        _staged.get().append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Deletes every table that this library left in the shared folder.  For the end of a job: results that read from
    them can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/ledgerframe")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_dense_ordinal(df: DataFrame, column: str, order: list[Column] | None = None, start: int = 0) -> DataFrame:
    """Numbers start, start + 1, ... over all rows, in `order` if given.

    Each partition counts its own rows; the partitions' counts, one small row each, give the offsets.  No window
    over the whole table, so no task holds more than a partition.
    """
    if order:
        df = df.orderBy(*order)
    placed = df.withColumns({"part__": F.spark_partition_id(), "row__": F.monotonically_increasing_id().bitwiseAND(2**33 - 1)})
    placed = materialized(placed, "ordinal")
    sizes = sorted((r.part__, r.n) for r in placed.groupBy("part__").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, at = [], start
    for part, n in sizes:
        offsets.append((part, at))
        at += n
    table = df.sparkSession.createDataFrame(offsets, "part__ int, offset__ bigint")
    return placed.join(F.broadcast(table), "part__").withColumn(column, F.col("offset__") + F.col("row__")).drop("part__", "row__", "offset__")


def uuid7(moment_ms: Column | None = None) -> Column:
    """A version 7 UUID: milliseconds, then random bits.  Materialise it before two uses."""
    ms = moment_ms if moment_ms is not None else F.unix_millis(F.current_timestamp())
    head = F.lpad(F.lower(F.hex(ms)), 12, "0")
    tail = F.regexp_replace(F.expr("uuid()"), "-", "")
    return F.concat(F.substring(head, 1, 8), F.lit("-"), F.substring(head, 9, 4), F.lit("-7"), F.substring(tail, 14, 3), F.lit("-"), F.substring(tail, 17, 4), F.lit("-"), F.substring(tail, 21, 12))
