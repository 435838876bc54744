"""Toxicity by weak supervision.

Voters - general word lists, lexicons drawn from labelled rows, and text patterns - each say toxic, clean or nothing.
A generative label model is estimated from their votes alone, whatever a row's label: a class prior, each voter's
votes given the class, and the correlations of voters within a class, by which correlated voters share their weight,
by expectation maximisation.  Labels then only say which of the two classes is toxic and how sure a posterior is (a
slope and an offset).  The posteriors are the labels on which a
linear classifier of words and votes is trained.  Scoring is one pass over all texts with the trained weights.

Fitting reads at most `sample_rows` labelled rows of each class and as many rows whatever their label, those of the
smallest hashed ids, one text an id; that is the documented bound of the sample.  What leaves the executors for the
driver is at most `most_features` word numbers and a short vector for each sampled row, however long its text.
Rows that `held_out` marks are never read for fitting.

Defined results: a null or empty text is scored by the intercept and the voters' silence; labels of null or of
documents that are absent are not used; where no row is labelled, the static lists alone decide; repeated rows
are scored each by itself, and one of those of one id (by the text's hash) may be in the sample; an empty table gives
an empty result.  Only doc_id and text of the documents are read, under whatever other columns there are.  Texts are
read whole, a slice at a time.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WORD_BYTE, columns, crc_of_id, free_name, kept, mix, run_hashes, slices, text_buffer, word_runs

#: Word lists of the static voters: general insults, words of contempt and threats (fixed values).
INSULTS = (
    "airhead bonehead buffoon clown coward creep cretin degenerate dimwit dolt dope dork dumbass dunce fool freak halfwit idiot imbecile jackass jerk "
    "liar loser lowlife lunatic maniac moron nitwit numbskull oaf parasite pervert psycho scum scumbag simpleton slob thug trash twit vermin weirdo wimp"
).split()
CONTEMPT = (
    "appalling brainless clueless contemptible deranged despicable disgraceful disgusting dumb filthy hateful hideous idiotic ignorant loathsome "
    "moronic nasty obnoxious pathetic repulsive ridiculous rotten shameful spineless stupid subhuman ugly useless vile worthless wretched"
).split()
THREATS = "burn choke crush destroy hang hurt kill murder shoot smash stab strangle suffer".split()
INSULTS = [*INSULTS, *(w + "s" for w in INSULTS)]

#: Lengths in bytes of the word beginnings that serve as features, beside whole words.
HEADS = (4, 5, 6)


@dataclass(frozen=True)
class ToxicitySpec:
    sample_rows: int = 4096
    most_features: int = 8192
    least_rows: int = 3
    least_share: float = 0.01
    odds: float = 20.0
    groups: int = 6
    rounds: int = 40
    threshold: float = 0.7


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each kind of feature, a 64-bit number for each word: the word, and its beginnings (0: shorter)."""
    kinds = [run_hashes(data, starts, ends)]
    for k, n in enumerate(HEADS):
        h = run_hashes(data, starts, np.minimum(ends, starts + n)) * np.uint64(2 * k + 3)
        kinds.append(np.where(ends - starts > n, h, np.uint64(0)))
    return kinds


def listed(words: list[str]) -> np.ndarray:
    raw = np.frombuffer("".join(words).encode(), np.uint8)
    size = np.array([len(w.encode()) for w in words])
    ends = np.cumsum(size)
    return np.sort(run_hashes(raw, ends - size, ends))


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Place of each x in sorted_values, or -1."""
    if len(sorted_values) == 0:
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[at] == x, at, -1)


def distinct_pairs(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return rows[new], values[new]


class Scanner:
    """What voters and classifier see of a batch of texts."""

    def __init__(self, names: np.ndarray, group: np.ndarray):
        """names: sorted numbers of the known features; group: the lexicon group of each, or -1."""
        self.names, self.group = names, group
        self.n_groups = int(group.max()) + 1 if len(group) and group.max() >= 0 else 0
        self.lists = [listed(x) for x in (INSULTS, CONTEMPT, THREATS)]

    def read(self, column: pa.Array) -> dict:
        raw, at = text_buffer(column)
        data = LOWER[raw]
        starts, ends, n_words = word_runs(data, at, WORD_BYTE)
        n = len(n_words)
        row = np.repeat(np.arange(n), n_words)
        kinds = word_features(data, starts, ends)
        hit_row, hit = [], []
        for h in kinds:
            where = _member(self.names, h)
            ok = where >= 0
            hit_row.append(row[ok])
            hit.append(where[ok])
        hit_row, hit = np.concatenate(hit_row), np.concatenate(hit)
        word_hits = np.zeros((n, self.n_groups), np.int64)
        g = self.group[hit] if len(hit) else np.zeros(0, np.int64)
        np.add.at(word_hits, (hit_row[g >= 0], g[g >= 0]), 1)
        static = np.stack([np.bincount(row[_member(x, kinds[0]) >= 0], minlength=n) for x in self.lists], 1)
        per = lambda mask: np.add.reduceat(np.concatenate([mask, [0]]).astype(np.int64), np.minimum(at[:-1], len(mask))) * (np.diff(at) > 0)
        n_bytes = np.maximum(np.diff(at), 1)
        caps, bangs = per((raw >= 65) & (raw <= 90)), per(raw == 33)
        return {"rows": hit_row, "hits": hit, "groups": word_hits, "static": static, "n_words": n_words, "caps": caps / n_bytes, "bangs": bangs / n_bytes}

    def votes(self, x: dict) -> np.ndarray:
        """(rows, voters) of -1 clean, 0 nothing, 1 toxic."""
        lexicon, static = x["groups"], x["static"]
        total = lexicon.sum(1) + static[:, :2].sum(1)
        out = [np.where(static[:, i] > 0, 1, 0) for i in range(static.shape[1])]
        out += [np.where(lexicon[:, i] > 0, 1, 0) for i in range(lexicon.shape[1])]
        out.append(np.where(total >= 2, 1, np.where(total == 0, -1, 0)))
        out.append(np.where((total * 50 >= x["n_words"]) & (total > 0), 1, 0))
        out.append(np.where(x["caps"] > 0.5, 1, 0))
        out.append(np.where(x["bangs"] > 0.02, 1, 0))
        out.append(np.where((total == 0) & (x["n_words"] >= 20), -1, 0))
        return np.stack(out, 1).astype(np.int8)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class LabelModel:
    """Votes given a hidden class, by expectation maximisation.

    Each round estimates, from the posteriors so far, the class prior, how often each voter votes what within each class
    (`given`), and how voters correlate within the classes (`correlation`); a voter's weight is one over its summed
    squared correlations with all voters, so that voters who say the same are counted once.  `accuracy` is each voter's
    chance of being right when it speaks."""

    def __init__(self, rounds: int):
        self.rounds = rounds

    def fit(self, votes: np.ndarray) -> "LabelModel":
        """From votes (-1 clean, 0 nothing, 1 toxic) alone; it begins with what most voters say."""
        onehot = np.stack([votes == v for v in (-1, 0, 1)], 2).astype(float)
        post = _sigmoid(votes.sum(1).astype(float))
        for _ in range(self.rounds):
            self.prior = (post.sum() + 1) / (len(post) + 2)
            counts = [np.einsum("n,nmv->mv", p, onehot) + 0.5 for p in (1 - post, post)]
            self.given = [c / c.sum(1, keepdims=True) for c in counts]
            self.correlation = self._correlations(votes, post)
            self.share = 1.0 / (self.correlation**2).sum(1)
            post = self.posterior(votes)
        right, spoken = counts[1][:, 2] + counts[0][:, 0], sum(c[:, [0, 2]].sum(1) for c in counts)
        self.accuracy = right / spoken
        return self

    @staticmethod
    def _correlations(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
        """Correlations within the classes, averaged by the classes' size."""
        corr = np.zeros((votes.shape[1],) * 2)
        for p in (post, 1 - post):
            w = p / max(p.sum(), 1e-9)
            x = votes - w @ votes
            cov = (x * w[:, None]).T @ x
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr += p.mean() * cov / np.outer(sd, sd)
        np.fill_diagonal(corr, 1.0)
        return np.clip(corr, -1, 1)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        ratio = np.log(self.given[1]) - np.log(self.given[0])
        told = ratio[np.arange(votes.shape[1]), votes.astype(int) + 1]
        return _sigmoid(np.log(self.prior / (1 - self.prior)) + (told * self.share).sum(1))


def calibrated(post: np.ndarray, known: np.ndarray) -> tuple[float, float]:
    """Slope and offset on the log odds of posteriors that fit the rows whose label is known, each class counting the
    same; a negative slope says that the classes are the other way round.  Two numbers are all that labels decide."""
    told = known >= 0
    if not (known == 1).any() or not (known == 0).any():
        return 1.0, 0.0
    z, y = np.clip(_logit(post[told]), -12, 12), known[told].astype(float)
    n1, n0 = y.sum(), (1 - y).sum()
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    slope, offset = 0.0, 0.0
    for _ in range(50):  # Newton steps with a little ridge
        p = _sigmoid(slope * z + offset)
        g = np.array([(weight * (p - goal) * z).sum() + 1e-4 * slope, (weight * (p - goal)).sum() + 1e-4 * offset])
        h = weight * p * (1 - p)
        hessian = np.array([[(h * z * z).sum() + 1e-4, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-4]])
        step = np.linalg.solve(hessian, g)
        slope, offset = slope - np.clip(step[0], -1, 1), offset - np.clip(step[1], -2, 2)
    return float(slope), float(offset)


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log(np.clip(p, 1e-13, 1)) - np.log(np.clip(1 - p, 1e-13, 1))


class ToxicityModel:
    """A fitted scorer: known features, their lexicon groups, and the weights of the linear classifier."""

    def __init__(self, scanner: Scanner, weights: np.ndarray, vote_weights: np.ndarray, bias: float):
        self.scanner, self.weights, self.vote_weights, self.bias = scanner, weights, vote_weights, bias

    def inputs(self, x: dict) -> np.ndarray:
        """Votes, and how many marks there are: at all, different ones, and against the text's length."""
        learned, static = x["groups"].sum(1), x["static"][:, :2].sum(1)
        different = np.bincount(distinct_pairs(x["rows"], x["hits"])[0], minlength=len(learned))
        share = [y / np.maximum(x["n_words"], 1) for y in (learned, static)]
        rest = np.stack([np.log1p(learned), np.log1p(static), np.log1p(different), *(100 * y / (1 + 100 * y) for y in share)], 1)
        v = self.scanner.votes(x)
        return np.concatenate([v == 1, v == -1, rest], 1).astype(float)

    def score(self, column: pa.Array) -> np.ndarray:
        x = self.scanner.read(column)
        z = self.bias + self.inputs(x) @ self.vote_weights + self.words(x)
        return _sigmoid(z)

    def words(self, x: dict) -> np.ndarray:
        """The mean weight of the text's marks, so that length alone moves nothing."""
        r, h = distinct_pairs(x["rows"], x["hits"])
        n = len(x["n_words"])
        return np.bincount(r, self.weights[h], minlength=n) / np.maximum(np.bincount(r, minlength=n), 1)


def _slice_features(texts: pa.Array):
    """(row, word number) by kind of feature, of one slice, and a number for each row that near copies mostly share:
    its smallest pair of neighbouring words."""
    raw, at = text_buffer(texts)
    data = LOWER[raw]
    starts, ends, n_words = word_runs(data, at, WORD_BYTE)
    row = np.repeat(np.arange(len(n_words)), n_words)
    kinds = word_features(data, starts, ends)
    pairs = mix(kinds[0] * np.uint64(3) + np.concatenate([kinds[0][1:], [np.uint64(0)]])) if len(row) else kinds[0]
    sign = np.full(len(n_words), np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(sign, row, pairs)
    return [(row[h != 0], h[h != 0]) for h in kinds], sign


def feature_counts(batches):
    """For each slice of labelled rows: how many clean rows hold a feature, and the signs of the toxic rows that do."""
    for whole in batches:
        for batch in slices(whole):
            y = batch.column("known").to_numpy(zero_copy_only=False)
            found = [np.zeros((0, 3), np.int64)]
            features, sign = _slice_features(batch.column("text"))
            for row, h in features:
                name, n = np.unique(distinct_pairs(row[y[row] == 0], h[y[row] == 0])[1], return_counts=True)
                found.append(np.stack([name.view(np.int64), np.zeros(len(name), np.int64), n], 1))
                r, name = distinct_pairs(row[y[row] == 1], h[y[row] == 1])
                found.append(np.stack([name.view(np.int64), sign[r].view(np.int64), np.full(len(r), -1)], 1))
            rows = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["name", "sign", "clean"])


def known_features(labelled: DataFrame, n1: int, n0: int, spec: ToxicitySpec) -> tuple[np.ndarray, np.ndarray]:
    """Words and beginnings that mark class 1 in the labelled sample, and the lexicon group of each; counted where the
    rows are, only the best `most_features` come to the driver.  Toxic rows of one sign, such as copies, count once."""
    least = max(spec.least_rows, spec.least_share * n1)
    counts = labelled.mapInArrow(feature_counts, "name bigint, sign bigint, clean bigint")
    by_sign = counts.groupBy("name", "sign", (F.col("clean") < 0).alias("is_toxic")).agg(F.sum("clean").alias("clean"))
    names = by_sign.groupBy("name").agg(F.count(F.when(F.col("is_toxic"), 1)).alias("toxic"), F.coalesce(F.sum(F.when(~F.col("is_toxic"), F.col("clean"))), F.lit(0)).alias("clean"))
    toxic, clean = F.col("toxic"), F.col("clean")
    gain = F.log((toxic + 0.5) / (n1 + 1)) - F.log((clean + 0.5) / (n0 + 1))
    # words that only speak for class 0 would count against a text the longer it is; silence of the marks does that
    strength = (toxic / max(n1, 1) - clean / max(n0, 1)) / F.sqrt((toxic + clean + 1) / (n1 + n0))
    best = names.where((toxic >= least) & (gain > float(np.log(spec.odds)))).withColumn("strength", strength).where("strength > 0")
    found = best.orderBy(F.desc("strength"), "name").limit(spec.most_features).select("name").collect()
    found = np.sort(np.array([r.name for r in found], np.int64).view(np.uint64))
    return found, (found >> np.uint64(40)).astype(np.int64) % spec.groups


def seen(rows: DataFrame, model: "ToxicityModel", known: str = "known") -> list:
    """(known, votes, inputs, features) of each sampled row, read where the rows are."""
    blob = rows.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by most_features

    def run(batches):
        fitted = pickle.loads(blob.value)
        for whole in batches:
            for batch in slices(whole):
                x = fitted.scanner.read(batch.column("text"))
                r, h = distinct_pairs(x["rows"], x["hits"])
                cut = np.searchsorted(r, np.arange(batch.num_rows + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column(known), pa.array(list(fitted.scanner.votes(x)), pa.list_(pa.int8())),
                    pa.array(list(fitted.inputs(x)), pa.list_(pa.float64())), pa.array([h[a:b] for a, b in zip(cut, cut[1:])], pa.list_(pa.int64())),
                ], ["doc_id", "known", "votes", "inputs", "hits"])

    read = rows.mapInArrow(run, "doc_id bigint, known int, votes array<tinyint>, inputs array<double>, hits array<bigint>")
    found = read.toArrow().sort_by([("doc_id", "ascending"), ("known", "ascending")])
    return [found[c].to_pylist() for c in ("known", "votes", "inputs", "hits")]


def fit_classifier(inputs: np.ndarray, hits: list, goal: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of features and inputs, and the intercept, by which a logistic model comes closest to `goal`."""
    n = len(goal)
    r, h = np.repeat(np.arange(n), [len(x) for x in hits]), np.array([i for x in hits for i in x], np.int64)
    each = 1 / np.maximum(np.bincount(r, minlength=n), 1)[r]
    w, v, b = np.zeros(n_features), np.zeros(inputs.shape[1]), 0.0
    gw, gv, gb = np.full(len(w), 1e-6), np.full(len(v), 1e-6), 1e-6
    for _ in range(300):  # full-batch steps sized by the squared gradients so far
        p = _sigmoid(b + inputs @ v + np.bincount(r, w[h] * each, minlength=n))
        e = (p - goal) / n
        dw, dv, db = np.bincount(h, e[r] * each, minlength=len(w)) + 1e-4 * w, e @ inputs + 1e-5 * v, e.sum()
        gw, gv, gb = gw + dw**2, gv + dv**2, gb + db**2
        w, v, b = w - 0.1 * dw / np.sqrt(gw), v - 0.1 * dv / np.sqrt(gv), b - 0.1 * db / np.sqrt(gb)
    return w, v, float(b)


def targets(votes: np.ndarray, known: np.ndarray, spec: ToxicitySpec) -> tuple[np.ndarray, LabelModel]:
    """What the classifier is trained on: posteriors of the votes alone, oriented and scaled by known labels."""
    model = LabelModel(spec.rounds).fit(votes)
    post = model.posterior(votes)
    slope, offset = calibrated(post, known)
    return _sigmoid(slope * np.clip(_logit(post), -12, 12) + offset), model


def held_out(doc_id):
    return F.pmod(crc_of_id(doc_id), F.lit(3)) == 1


def sampled(docs: DataFrame, labels: DataFrame, spec: ToxicitySpec) -> DataFrame:
    """(doc_id, text, known) of the sample: rows of either label, and rows of any, whose known is -1."""
    y = columns(labels, doc_id="bigint", toxic="int").where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max("toxic").alias("known"))
    d = columns(docs, doc_id="bigint", text="string")
    parts = [y.where(F.col("known") == value) for value in (0, 1)]
    parts.append(d.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct().withColumn("known", F.lit(-1)))
    chosen = None
    for part in parts:
        part = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(spec.sample_rows)
        chosen = part if chosen is None else chosen.unionAll(part)
    chosen = kept(chosen.groupBy("doc_id").agg(F.max("known").alias("known")), "toxicity-sample")
    # at most 3 * sample_rows ids, so this travels; of an id's rows one text is taken
    rows = d.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "known").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return kept(rows.repartition(16, "doc_id"), "toxicity-rows")


def learn(docs: DataFrame, labels: DataFrame, spec: ToxicitySpec = ToxicitySpec()) -> ToxicityModel:
    """A model from the sample of rows that aren't held out."""
    rows = sampled(docs, labels, spec)
    labelled = rows.where(F.col("known") >= 0)
    sizes = {r.known: r.n for r in labelled.groupBy("known").agg(F.count(F.lit(1)).alias("n")).collect()}
    names, group = known_features(labelled, sizes.get(1, 0), sizes.get(0, 0), spec) if sizes.get(1) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    scanner = Scanner(names, group)
    if not sizes:
        voters = scanner.votes(scanner.read(pa.array([""]))).shape[1]
        w = np.zeros(2 * voters + 5)
        w[:2], w[2 * voters + 1] = 1.5, 1.0
        return ToxicityModel(scanner, np.zeros(0), w, -3.0)
    known, votes, inputs, hits = seen(rows, ToxicityModel(scanner, np.zeros(len(names)), np.zeros(0), 0.0))
    goal, _ = targets(np.array(votes, np.int8), np.array(known), spec)
    return ToxicityModel(scanner, *fit_classifier(np.array(inputs, float), hits, goal, len(names)))


def score_with(docs: DataFrame, model: ToxicityModel, name: str = "score", keep_all: bool = False) -> DataFrame:
    """`docs` (doc_id only, or all columns) with the score as column `name`."""
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by most_features
    source = docs if keep_all else columns(docs, doc_id="bigint", text="string")
    keep = docs.columns if keep_all else ["doc_id"]

    def run(batches):
        fitted = pickle.loads(blob.value)
        for whole in batches:
            for batch in slices(whole):
                score = pa.array(fitted.score(batch.column("text")), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), score], [*keep, name])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in keep), f"`{name}` double"])
    return source.mapInArrow(run, schema)


def toxicity_digest(docs: DataFrame, labels: DataFrame, spec: ToxicitySpec = ToxicitySpec()) -> DataFrame:
    scored = score_with(docs, learn(docs, labels, spec))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= spec.threshold).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, spec: ToxicitySpec = ToxicitySpec()) -> DataFrame:
    """`docs` without the rows whose score reaches the threshold."""
    name = free_name(docs, "toxic_score")
    scored = score_with(docs, learn(docs, labels, spec), name, keep_all=True)
    return scored.where(F.col(name) < spec.threshold).drop(name)
