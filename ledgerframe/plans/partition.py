"""Change batches: which changes are alike and worth one set-based write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import WriteNotSupported
from ..options import OnUnsupported, WriteOptions

#: A change row: table, state (Added, Modified, Deleted), ordered column lists, and what makes it ineligible.
CHANGES = "seq bigint, table string, state string, write array<string>, read array<string>, condition array<string>, procedure boolean, json_path boolean"


def by_shape(changes: DataFrame) -> DataFrame:
    """One row for each (table, state, shape) with its number of changes, by first appearance.  The order of the
    column lists is part of the shape."""
    shape = F.concat_ws("|", *[F.concat_ws(",", c) for c in ("write", "read", "condition")])
    return changes.withColumn("shape", shape).groupBy("table", "state", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max(F.coalesce("procedure", F.lit(False))).alias("procedure"), F.max(F.coalesce("json_path", F.lit(False))).alias("json_path")
    )


def with_eligibility(partitions: DataFrame, options: WriteOptions) -> DataFrame:
    """`reason`: why a partition isn't accelerated, null where it is."""
    reason = (
        F.when(F.col("procedure"), "stored procedure").when(F.col("json_path"), "part of a JSON column")
        .when(~F.col("state").isin("Added", "Modified", "Deleted"), "state").when(F.col("n") < options.threshold, "below threshold")
    )
    return partitions.withColumn("reason", reason)


@dataclass(frozen=True)
class Planned:
    table: str
    state: str
    shape: str
    n: int
    reason: str | None


def plan_partitions(changes: DataFrame, options: WriteOptions) -> list[Planned]:
    """Partitions by first appearance; one row each, as many as there are shapes.  Under RAISE an ineligible one is
    refused; being few is no reason to refuse."""
    rows = with_eligibility(by_shape(changes), options).orderBy("first_seq").collect()
    out = [Planned(r.table, r.state, r["shape"], r.n, r.reason) for r in rows]
    bad = [p for p in out if p.reason not in (None, "below threshold")]
    if bad and options.on_unsupported is OnUnsupported.RAISE:
        raise WriteNotSupported("; ".join(f"{p.state} of {p.table}: {p.reason}" for p in bad))
    return out
