"""Nulls in every column, repeated rows, ties, one very long text, extra columns and empty tables, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerframe.llm import license_scan, mixing, near_dedup, packing, phrase_prints, ppm, secret_scan, token_rollup, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
LONG = "lorem ipsum dolor sit amet " * 40_000
ROWS = [
    *[(None, None, None, None, None)] * 3, *[(1, "same row", "en", "a", 8)] * 3, (2, "same row", None, None, None), (None, "text without an id", "en", "a", 18),
    (3, "", "en", "b", 0), (4, LONG, "en", "b", len(LONG)), (5, "same id", "en", "a", 7), (5, "other text", "en", "a", 10), (-7, "Ünïcode \U0001f600 \x00 text", "fr", "ü", 20),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = {c: F.lit("x") for c in ("score", "span", "spans", "block", "kind", "rank", "mix_size", "row", "near_id", "toxic_score", "label")}
    return spark.createDataFrame(ROWS, DOCS).withColumns(extra)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, None, 0), (None, 1, 1), (4, 0, 0), (4, 0, 0), (99, 1, 1)], LABELS)


OPERATORS = {
    "license": lambda d, y: license_scan.license_digest(d), "secrets": lambda d, y: secret_scan.secret_digest(d), "toxicity": toxicity.toxicity_digest, "mixing": lambda d, y: mixing.mix_digest(d),
    "prints": lambda d, y: phrase_prints.compare_with_next(d), "print texts": lambda d, y: phrase_prints.print_texts(d), "near": lambda d, y: near_dedup.near_digest(d), "ppm": lambda d, y: ppm.ppm_scores(d),
    "counts": lambda d, y: token_rollup.counted(d, ("words-1",)), "packing": lambda d, y: packing.pack(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, labels, name):
    got = OPERATORS[name](docs, labels)
    ids = sorted((r.doc_id for r in got.select("doc_id").collect()), key=str)
    want = sorted((r[0] for r in ROWS), key=str)
    assert (set(ids) == set(want)) if name == "packing" else ids == want
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_clean_rows(spark, docs, labels, tmp_path, name, stage):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = stage(spark, docs, str(tmp_path))
    assert got.dtypes == docs.dtypes
    n = got.count()
    if name in ("toxicity", "secrets"):
        assert n == len(ROWS)
    if name == "near_dedup":  # three wordless null rows and an empty one stay; the same row once
        texts = sorted((r.text for r in got.select("text").collect()), key=str)
        assert sorted(t for t in texts if t) == sorted({r[1] for r in ROWS if r[1]})
        assert texts.count(None) == 3 and texts.count("") == 1


def test_results_do_not_depend_on_order(docs, labels):
    for name in ("license", "secrets", "mixing", "near", "prints"):
        a, b = OPERATORS[name](docs, labels), OPERATORS[name](docs.orderBy(F.desc("text")).repartition(3), labels)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
