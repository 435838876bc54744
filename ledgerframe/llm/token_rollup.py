"""Token counts as delta-maintained rollups.

A batch of document changes - inserts, deletes and revised counts - becomes signed sums by source, language and
tokenizer version, which are committed as one immutable delta.  Totals are the sums of all committed deltas, so
a change costs what it changes and not a recount.  A batch is committed by renaming its finished folder to the
folder of its id; an id that is there already is left as it is, so a repeated or retried commit changes nothing.

Counts are those of public vocabularies (byte-level BPE, by files whose path is a parameter) or of a pattern; a document
is counted once for all versions, in one pass over the texts, whole and a slice at a time.  All later steps are built-in
functions.  A delta has a row for each group, so batches of any size shrink before they are shuffled or written, and a
hot source is summed in every task first.

Defined results: a null or empty text has no tokens and counts as a document; null ids count as documents, and no delta
by id finds them; columns besides doc_id, source, lang and text are not read; null source or language is a group of its own; a null count counts as absent (null before:
insert, null after: delete, both null: no change); repeated rows of a batch each count; an empty batch commits
and changes nothing; groups whose documents and tokens are both 0 are left out of the totals.
"""

from __future__ import annotations

import base64
import re
import uuid
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, slices

#: Tokenizer versions (fixed values): rank files of public vocabularies, and patterns whose places in lower-case text
#: are the tokens.
VOCABULARIES = {"bpe-50k": "byte_bpe_50k.tiktoken", "bpe-multi-50k": "byte_bpe_multi_50k.tiktoken"}
PATTERNS = {"words-1": r"[^\x20\x09-\x0D]+", "alpha-2": r"[a-z]+"}

KEY = ("source", "lang", "tokenizer")


def vocabulary_file(version: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARIES[version])


@cache
def ranks(path: str):
    """The encoding of a rank file; what looks like a special token is ordinary text."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def counted(docs: DataFrame, tokenizers: tuple[str, ...], files: dict[str, str] | None = None) -> DataFrame:
    """doc_id, source, lang, and a column of counts for each tokenizer version; `files` names other rank files."""
    rows = columns(docs, doc_id="bigint", source="string", lang="string", text="string")
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    rows = rows.withColumns({t: F.regexp_count(text, F.lit(PATTERNS[t])).cast("bigint") for t in tokenizers if t in PATTERNS})
    paths = {t: (files or {}).get(t) or vocabulary_file(t) for t in tokenizers if t not in PATTERNS}
    if not paths:
        return rows.drop("text")
    plain = [c for c in rows.columns if c != "text"]

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                counts = [pa.array([len(ranks(p).encode_ordinary(x)) for x in texts], pa.int64()) for p in paths.values()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), *counts], [*plain, *paths])

    schema = ", ".join(["doc_id bigint", "source string", "lang string", *(f"`{c}` bigint" for c in [*plain[3:], *paths])])
    return rows.mapInArrow(run, schema)


def signed(changes: DataFrame) -> DataFrame:
    """Changes (source, lang, tokenizer, before, after) as additive sums by group."""
    was, now = F.col("before"), F.col("after")
    docs = now.isNotNull().cast("bigint") - was.isNotNull().cast("bigint")
    tokens = F.coalesce(now, F.lit(0)) - F.coalesce(was, F.lit(0))
    return changes.groupBy(*KEY).agg(F.sum(docs).cast("bigint").alias("docs"), F.sum(tokens).cast("bigint").alias("tokens"))


def inserts(counts: DataFrame, tokenizers: tuple[str, ...]) -> DataFrame:
    """Changes that add every document of `counts` under each tokenizer version."""
    each = [F.struct(F.lit(t).alias("tokenizer"), F.lit(None).cast("bigint").alias("before"), F.col(f"`{t}`").alias("after")) for t in tokenizers]
    return counts.select("source", "lang", F.inline(F.array(*each)))


def deletes(counts: DataFrame, tokenizers: tuple[str, ...]) -> DataFrame:
    """Changes that take every document of `counts` away again."""
    each = [F.struct(F.lit(t).alias("tokenizer"), F.col(f"`{t}`").alias("before"), F.lit(None).cast("bigint").alias("after")) for t in tokenizers]
    return counts.select("source", "lang", F.inline(F.array(*each)))


def revisions(counts: DataFrame, tokenizer: str, by: str) -> DataFrame:
    """Changes that revise the counts of `tokenizer` to those of column `by`."""
    return counts.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(f"`{tokenizer}`").alias("before"), F.col(f"`{by}`").alias("after"))


class RollupStore:
    """Committed deltas under a folder of any file system that Spark writes."""

    SCHEMA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/deltas"))
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.path}/deltas")))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commits the batch unless its id was committed before; says whether it did."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9-]*", batch):
            raise ValueError(f"a batch id is letters, digits and hyphens, not {batch!r}")
        done = self._path(f"{self.path}/deltas/{batch}")
        if self._fs.exists(done):
            return False
        work = f"{self.path}/work-{batch}-{uuid.uuid4().hex}"
        signed(changes).write.mode("overwrite").parquet(work)
        plain = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._context.rename(self._path(work), done, plain)  # fails where the folder exists
        except Exception:
            self._fs.delete(self._path(work), True)
            if self._fs.exists(done):  # another writer was first
                return False
            raise
        return True

    def totals(self) -> DataFrame:
        """Documents and tokens by source, language and tokenizer version over all committed batches."""
        paths = [f"{self.path}/deltas/{b}" for b in self.batches()]
        deltas = self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)
        sums = deltas.groupBy(*KEY).agg(F.sum("docs").cast("bigint").alias("docs"), F.sum("tokens").cast("bigint").alias("tokens"))
        return sums.where((F.col("docs") != 0) | (F.col("tokens") != 0))
