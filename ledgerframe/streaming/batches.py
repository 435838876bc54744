"""Finite streams of batches in keyset order, and micro-batches of a structured stream as bulk writes."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row

from ..errors import WriteNotSupported
from ..operators.keyset import KeysetDefinition
from ..options import QueryOptions


def stream_batches(df: DataFrame, keys: KeysetDefinition, batch: int | None = None, options: QueryOptions = QueryOptions(), cancel: threading.Event | None = None) -> Iterator[list[Row]]:
    """Batches in keyset order; the ordering is checked before the first read, and none is empty.

    The table is put in order once, in ranges over all tasks, and its ranges come to the driver one after another; so
    a stream costs one sort however many batches it has, and sees the table as it was when it began."""
    keys.validate()
    size = batch or options.batch_size

    def run():
        rows = keys.order(df).toLocalIterator()
        while lot := list(islice(rows, size)):
            if cancel is not None and cancel.is_set():
                return
            yield lot

    return run()


def stream(df: DataFrame, keys: KeysetDefinition, batch: int | None = None, options: QueryOptions = QueryOptions(), cancel: threading.Event | None = None) -> Iterator[Row]:
    batches = stream_batches(df, keys, batch, options, cancel)

    def run():
        for rows in batches:
            for row in rows:
                if cancel is not None and cancel.is_set():
                    return
                yield row

    return run()


def for_each_batch(write: Callable[[DataFrame], object]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler that writes each nonempty micro-batch, for example by a session's merge."""

    def handle(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            write(batch)

    return handle


def write_stream(df: DataFrame, write: Callable[[DataFrame], object], checkpoint: str, include_graph: bool = False, **trigger):
    """Starts a query that sends every micro-batch to `write`."""
    if include_graph:
        raise WriteNotSupported("a stream of rows can't bring related rows along")
    writer = df.writeStream.foreachBatch(for_each_batch(write)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
