"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length within each source.  A source's budget first takes the same share of
every length; what rounding leaves is fitted by a bounded-knapsack dynamic programme (reachable sums as bits of
an integer, counts by doubling).  The documents of a length are then selected by a seeded hash: those at or
below the hash that the wanted count reaches.

Only counts by (source, length) meet in one task; a source has at most sqrt(2 * its words) lengths.  Targets
are reshared by sums over a table of the sources, so the driver sees a few numbers.  The wanted hash is found in hash ranges of about `range_docs` rows, so a length
that a third of all rows share is spread over many tasks.

Defined results: a null text has size 0 and adds no words, and is in the mix as often as its source is taken whole; a null source is a source of its own and comes last;
rows of one id and text are selected together, and if the wanted count falls between them, not at all; an empty
table gives an empty result; extra columns stay untouched in `mix_rows` and unread in `mix_plan`.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.ordinals import with_dense_ordinal
from .common import columns, kept

#: Words of a text (whitespace is space, tab to carriage return).
TOKENS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixSpec:
    """weights repeat over the sources in code point order; share is the mix's size against all sizes; limit is
    the most that a source or a document may be repeated; window is the number of words left to the knapsack."""

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.5
    limit: int = 2
    seed: int = 7
    window: int = 1 << 16
    range_docs: int = 256


def targets(sizes: list[int], spec: MixSpec) -> list[float]:
    """Budgets by weight; those above limit * size stop there and the rest is shared anew."""
    weight = [spec.weights[i % len(spec.weights)] for i in range(len(sizes))]
    out, active, budget = [0.0] * len(sizes), list(range(len(sizes))), spec.share * sum(sizes)
    while active:
        total = sum(weight[i] for i in active)
        over = [i for i in active if budget * weight[i] / total > spec.limit * sizes[i]]
        for i in over or active:
            out[i] = float(spec.limit * sizes[i]) if over else budget * weight[i] / total
        if not over:
            break
        budget -= sum(out[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return out


def budgets(lengths: DataFrame, spec: MixSpec) -> DataFrame:
    """(source, source_size, target) of every source, as `targets` gives them: places in code point order come from
    counts of sorted ranges, and a round of resharing is one sum, so the driver holds a few numbers."""
    sized = lengths.groupBy("source").agg(F.sum(F.col("mix_size") * F.col("n")).alias("source_size"))
    placed = with_dense_ordinal(sized, "place", [F.col("source").isNull(), F.col("source")])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in spec.weights]), (F.col("place") % len(spec.weights) + 1).cast("int"))
    rows = kept(placed.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * spec.limit).cast("double").alias("most")), "mix-sources")
    budget = spec.share * float(rows.agg(F.sum("source_size").alias("s")).first().s or 0)
    active, share = rows.withColumn("target", F.lit(None).cast("double")), None
    while True:
        total = active.where("target IS NULL").agg(F.sum("weight").alias("w")).first().w
        if not total:
            break
        share = F.lit(budget) * F.col("weight") / F.lit(float(total))
        over = F.col("target").isNull() & (share > F.col("most"))
        stopped = active.where(over).agg(F.count(F.lit(1)).alias("n"), F.sum("most").alias("m")).first()
        if not stopped.n:
            active = active.withColumn("target", F.coalesce("target", share))
            break
        active = kept(active.withColumn("target", F.when(over, F.col("most")).otherwise(F.col("target"))), "mix-targets")
        budget -= stopped.m
    return kept(active.select("source", "source_size", "target"), "mix-targets")


def fit(counts: dict[int, int], budget: int, window: int) -> dict[int, int]:
    """How many documents of each length to take, at most `counts`, so that their sum comes closest to `budget`
    from below: a share of each, long lengths until `window` words are left, then the knapsack."""
    total = sum(x * n for x, n in counts.items())
    budget = min(budget, total)
    if budget <= 0:
        return {}
    taken = {x: n * budget // total for x, n in counts.items() if x > 0}
    left = budget - sum(x * n for x, n in taken.items())
    order = sorted(taken, reverse=True)
    for x in order:
        if left <= window:
            break
        n = min(counts[x] - taken[x], (left - window // 2) // x)
        if n > 0:
            taken[x] += n
            left -= n * x
    reach, steps, full = 1, [], 1 << left
    mask = (full << 1) - 1
    for x in order:
        n, times = min(counts[x] - taken[x], left // x), 1
        while n > 0 and not reach & full:
            take = min(times, n)
            steps.append((x, take, reach))
            reach |= (reach << (x * take)) & mask
            n, times = n - take, times * 2
        if reach & full:
            break
    at = reach.bit_length() - 1
    for x, take, before in reversed(steps):
        if not before >> at & 1:
            taken[x] += take
            at -= x * take
    return {x: n for x, n in taken.items() if n}


def _sized(docs: DataFrame, spec: MixSpec) -> DataFrame:
    return docs.withColumns({"mix_size": F.coalesce(F.regexp_count("text", F.lit(TOKENS)), F.lit(0)).cast("bigint"), "mix_hash": F.xxhash64(F.lit(spec.seed), F.col("doc_id"), F.col("text"))})


def mix_plan(docs: DataFrame, spec: MixSpec = MixSpec()) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): `rows` has doc_id, source, mix_size, mix_hash of every document; `plan` has for each source
    and length the copies that every document of it gets and the hash up to which one copy more is taken."""
    rows = kept(_sized(columns(docs, doc_id="bigint", text="string", source="string"), spec).drop("text"), "mix-rows")
    lengths = kept(rows.groupBy("source", "mix_size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    window, limit = spec.window, spec.limit
    goals = budgets(lengths, spec).withColumnRenamed("source", "g_source")
    aimed = lengths.join(goals, F.col("source").eqNullSafe(F.col("g_source"))).drop("g_source")

    def plan_source(part: pd.DataFrame) -> pd.DataFrame:
        size, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        whole = min(limit, int(target // size)) if size else 0
        extra = fit(dict(zip(part["mix_size"].tolist(), part["n"].tolist())), min(round(target), limit * size) - whole * size, window)
        return part.assign(copies=whole, more=[extra.get(x, 0) for x in part["mix_size"]])

    plan = kept(aimed.groupBy("source").applyInPandas(plan_source, "source string, mix_size bigint, n bigint, source_size bigint, target double, copies bigint, more bigint"), "mix-plan")
    # the hash that the wanted count reaches: first the range of hashes, then the place in it
    partly = plan.where((F.col("more") > 0) & (F.col("more") < F.col("n"))).select(F.col("source").alias("p_source"), F.col("mix_size").alias("p_size"), "n", "more")
    ranged = (
        rows.join(partly, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("mix_size") == F.col("p_size")))
        .withColumn("range", F.floor((F.col("mix_hash").cast("double") / F.lit(2.0**64) + F.lit(0.5)) * F.ceil(F.col("n") / F.lit(spec.range_docs))))
        .groupBy("source", "mix_size", "range", "mix_hash", "more").agg(F.count(F.lit(1)).alias("m"))
    )
    ranged = kept(ranged, "mix-ranges")
    key = ["source", "mix_size"]
    by_range = ranged.groupBy(*key, "range", "more").agg(F.sum("m").alias("m"))
    before = by_range.withColumn("upto", F.sum("m").over(W.partitionBy(*key).orderBy("range"))).withColumn("before", F.col("upto") - F.col("m"))
    edge = before.where((F.col("before") < F.col("more")) & (F.col("upto") >= F.col("more"))).select(F.col("source").alias("e_source"), F.col("mix_size").alias("e_size"), F.col("range").alias("e_range"), "before")
    inside = ranged.join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("mix_size") == F.col("e_size")) & (F.col("range") == F.col("e_range")))
    placed = inside.withColumn("place", F.col("before") + F.sum("m").over(W.partitionBy(*key, "range").orderBy("mix_hash")))
    # the last hash with place <= more; if the range's first hash already exceeds it, all hashes before the range
    cut = placed.groupBy(*key).agg(F.max(F.when(F.col("place") <= F.col("more"), F.col("mix_hash"))).alias("last"), (F.min("mix_hash") - 1).alias("under"))
    cut = cut.select(F.col("source").alias("c_source"), F.col("mix_size").alias("c_size"), F.coalesce("last", "under").alias("upto_hash"))
    plan = plan.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("mix_size") == F.col("c_size")), "left").select(
        "source", "mix_size", "source_size", "target", "copies",
        F.when(F.col("more") >= F.col("n"), F.lit(2**63 - 1)).when(F.col("more") > 0, F.col("upto_hash")).alias("upto_hash"),
    )
    return rows, kept(plan, "mix-cuts")


def _with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    p = plan.select(F.col("source").alias("mix_source"), F.col("mix_size").alias("mix_length"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), F.col("copies").alias("mix_whole"), "upto_hash")
    joined = rows.join(p, F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("mix_size") == F.col("mix_length")))
    return joined.withColumn("mix_copies", F.col("mix_whole") + F.coalesce(F.col("mix_hash") <= F.col("upto_hash"), F.lit(False)).cast("bigint")).drop("mix_source", "mix_length", "mix_whole", "upto_hash")


def mix_digest(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """Every document's size, its source's size and target, and the words that the mix takes of it."""
    rows, plan = mix_plan(docs, spec)
    return _with_copies(rows, plan).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


def mix_rows(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, with the columns of `docs`."""
    _, plan = mix_plan(docs, spec)
    row, text = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text")
    whole = docs.select(row, F.col("doc_id").cast("bigint").alias("doc_id"), text, F.col("source").cast("string").alias("source"))
    copies = _with_copies(_sized(whole, spec).drop("text", "doc_id"), plan).where(F.col("mix_copies") > 0)
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int"))).alias("copy")).select("row.*")
