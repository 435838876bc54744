"""Questions to an audit trail."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.payload import changed_contains, contains


def history(trail: DataFrame, entity_type: str, key: str) -> DataFrame:
    """One row's entries, the latest first."""
    return trail.where((F.col("entity_type") == entity_type) & (F.col("entity_key") == key)).orderBy(F.desc("occurred_at"), F.desc("id"))


def by_actor(trail: DataFrame, actor_id: str, since: dt.datetime | None = None) -> DataFrame:
    return _since(trail.where(F.col("actor_id") == actor_id), since)


def by_tenant(trail: DataFrame, tenant_id: str, since: dt.datetime | None = None) -> DataFrame:
    return _since(trail.where(F.col("tenant_id") == tenant_id), since)


def by_correlation(trail: DataFrame, correlation_id: str) -> DataFrame:
    return trail.where(F.col("correlation_id") == correlation_id)


def _since(trail: DataFrame, since: dt.datetime | None) -> DataFrame:
    return trail if since is None else trail.where(F.col("occurred_at") >= F.lit(since).cast("timestamp_ntz"))


def having(trail: DataFrame, wanted: dict) -> DataFrame:
    """Entries whose document contains `wanted`, such as {"new": {"Status": "Shipped"}}."""
    return trail.where(contains(F.col("changes"), wanted))


def changing(trail: DataFrame, column: str) -> DataFrame:
    """Updates that changed the column."""
    return trail.where(changed_contains(F.col("changes"), column))


def path_value(trail: DataFrame, path: str, name: str) -> DataFrame:
    """The trail with the value at a JSON path as a column."""
    return trail.withColumn(name, F.get_json_object("changes", path))
