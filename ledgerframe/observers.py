"""What may watch a write before it commits."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import TableModel
from .options import Op


class Needs(Enum):
    NOTHING = 0
    ROWS = 1
    ALL = 2


@dataclass(frozen=True)
class Observation:
    """A write's rows: `changes` (op, old, new), and from it the written rows, their before-images, and rows that a
    synchronize removed."""

    model: TableModel
    op: Op
    changes: DataFrame
    before_images: bool

    @property
    def rows(self) -> DataFrame:
        return self.changes.where(F.col("new").isNotNull()).select("new.*")

    @property
    def before(self) -> DataFrame:
        return self.changes.where(F.col("old").isNotNull()).select("old.*")

    @property
    def removed(self) -> DataFrame:
        return self.changes.where(F.col("op") == "DELETE").select("old.*")


class WriteObserver(Protocol):
    def observes(self, model: TableModel, op: Op) -> Needs: ...

    def observed(self, observation: Observation, transaction) -> None:
        """Called after the rows are written and before the commit; what it raises undoes the write."""
