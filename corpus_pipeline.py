"""The corpus pipeline: toxicity filter, near-duplicate removal, secret redaction, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on everything that the one before kept.  All but the last return the
columns of `docs`; the last returns the packed pieces.

Defined results, for every stage: an empty table gives an empty result; extra columns, whatever their names, stay as they
are up to packing; texts are read whole.  Null and empty texts, and rows without an id, stay (near_dedup keeps every row
without words; mixing takes a row of size 0 as often as its source is taken whole; packing gives it its closing id).
Repeated rows are kept or dropped each by itself, but for near_dedup, which keeps one.  Ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerframe.llm.common import kept, on_workers, table
from ledgerframe.llm.mixing import mix_rows
from ledgerframe.llm.near_dedup import without_near_copies
from ledgerframe.llm.packing import pack
from ledgerframe.llm.secret_scan import redact
from ledgerframe.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    on_workers(spark)
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    on_workers(spark)
    return without_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets blotted out."""
    on_workers(spark)
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    on_workers(spark)
    return mix_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    on_workers(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The near-duplicate, classifier and packing stages have no SQL form.  A test runs the stages in a row on a small corpus
#: and holds each against a brute-force form of it.
ORACLE_SQL = None
