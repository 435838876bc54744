"""The registered queries of this package: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .ann_forest import search
from .common import kept, shared_dir, table
from .license_scan import license_digest
from .mixing import mix_digest
from .near_dedup import near_digest
from .packing import pack
from .phrase_prints import compare_with_next
from .ppm import ppm_scores
from .secret_scan import secret_digest
from .token_rollup import RollupStore, counted, deletes, inserts, revisions
from .toxicity import toxicity_digest


def op1_license_scan(spark, sf_dir):
    return license_digest(table(spark, sf_dir, "documents"))


def op2_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def op3_ann_forest(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"))


def op4_mixing(spark, sf_dir):
    return mix_digest(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _rollup(spark, sf_dir, counts, versions):
    """A store after four commits: all documents, the same batch again (no effect), deletes of documents labelled as
    low quality, and revised word counts of the rest under a newer rule."""
    labels = table(spark, sf_dir, "labels")
    low = labels.where(F.col("quality") == 0).select("doc_id").distinct()
    store = RollupStore(spark, f"{shared_dir(spark)}/ledgerframe/rollup-{uuid.uuid4().hex}")
    store.commit("2024-01-load", inserts(counts, versions))
    store.commit("2024-01-load", inserts(counts, versions))
    store.commit("2024-02-removal", deletes(counts.join(low, "doc_id", "left_semi"), versions))
    store.commit("2024-03-revision", revisions(counts.join(low, "doc_id", "left_anti"), "words-1", "alpha-2"))
    return store


def op6_token_rollup(spark, sf_dir):
    """Totals by a word rule and two public vocabularies: `_rollup`, and then documents labelled as good move from one
    vocabulary to the other."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    # counted once; what is joined and summed later is a few numbers a document
    counts = kept(counted(docs, ("words-1", "alpha-2", "bpe-50k", "bpe-multi-50k")), "rollup-counts")
    store = _rollup(spark, sf_dir, counts, ("words-1", "bpe-50k"))
    moved = counts.join(labels.where(F.col("quality") == 1).select("doc_id").distinct(), "doc_id", "left_semi")
    moved = moved.join(labels.where(F.col("quality") == 0).select("doc_id").distinct(), "doc_id", "left_anti")
    store.commit("2024-04-vocabulary", deletes(moved, ("bpe-50k",)).unionAll(inserts(moved, ("bpe-multi-50k",))))
    return store.totals()


def rollup_by_words(spark, sf_dir):
    """The part of op6_token_rollup that SQL can express: totals by the word rule."""
    counts = kept(counted(table(spark, sf_dir, "documents"), ("words-1", "alpha-2")), "rollup-counts")
    return _rollup(spark, sf_dir, counts, ("words-1",)).totals()


def op7_secret_scan(spark, sf_dir):
    return secret_digest(table(spark, sf_dir, "documents"))


def op8_phrase_prints(spark, sf_dir):
    return compare_with_next(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark, sf_dir):
    return near_digest(table(spark, sf_dir, "documents"))


def op10_ppm_score(spark, sf_dir):
    return ppm_scores(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_packing, op3_ann_forest, op4_mixing, op5_toxicity,
        op6_token_rollup, op7_secret_scan, op8_phrase_prints, op9_near_dedup, op10_ppm_score, rollup_by_words,
    )
}
