"""Near duplicates by MinHash bands with sequential Bayesian verification, confirmed on full shingle sets.

1. A text's set is its distinct five-word shingles (64-bit hashes of the words' hashes); texts of equal sets
   are one node from there on, so exact copies never meet each other again.
2. Each node's signature is cut into bands; nodes of one band value share a bucket.
3. Within a bucket, signatures are compared batch by batch: a pair is dropped as soon as the posterior chance
   that its similarity reaches the threshold falls below `miss`.  Surviving pairs only say which nodes belong
   to one group: a spanning forest of them is all that leaves a bucket.  Buckets above `bucket_rows` skip the
   comparison and put all their nodes into one group, which can only make groups wider.
4. Within a group, links are decided on full sets: a breadth-first search compares each found node with
   those not yet found.  Groups above `group_rows` are searched in chunks, then the nodes outside the largest
   component of their group are compared with all of its chunks; so no pair of different components is left out.

A pair at the threshold shares no band with probability (1 - t**rows)**bands, 4e-7 as set here (NearSpec() for
`near_digest`, STAGE for `without_near_copies`), and is pruned wrongly with probability below `miss`.  Links themselves are exact.

Defined results: null text, or a text without words, has an empty set, links with nothing and is kept; a text of
fewer words than a shingle is one shingle of all its words; rows of one id and different texts are different
nodes; rows without an id join components but give them no name (a component without any id has a null name and
its rows count as kept); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, columns, free_name, hash_set, kept, maybe_in, mix, pieces, run_hashes, slices, text_buffer, word_runs
from .components import components


@dataclass(frozen=True)
class NearSpec:
    """`numerator`/`denominator` is the least Jaccard similarity of a link."""

    numerator: int = 85
    denominator: int = 100
    words: int = 5
    bands: int = 20
    rows: int = 4
    batch: int = 16
    miss: float = 1e-6
    bucket_rows: int = 2048
    group_rows: int = 1024

    @property
    def threshold(self) -> float:
        return self.numerator / self.denominator


#: For stages without a contract of their own: five words, similarity 0.8.  At 0.8, 28 bands miss as few pairs as 20 at 0.85.
STAGE = NearSpec(numerator=80, bands=28)


def pruning_table(spec: NearSpec) -> list[tuple[int, int]]:
    """(hashes seen, least agreements to go on): below it, P(similarity >= t | agreements) < miss under a uniform
    prior.  With m of n agreeing that chance is P(Binomial(n + 1, t) <= m)."""
    table, total, t = [], spec.bands * spec.rows, spec.threshold
    for n in range(spec.batch, total + 1, spec.batch):
        below, m = 0.0, 0
        while m <= n and (below := below + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < spec.miss:
            m += 1
        table.append((n, m))
    return table


def shingle_sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, sorted within each text, and how many each text has."""
    raw, at = text_buffer(column)
    data = LOWER[raw]
    starts, ends, n_words = word_runs(data, at, NOT_SPACE)
    h = run_hashes(data, starts, ends)
    row = np.repeat(np.arange(len(n_words)), n_words)
    first = np.cumsum(n_words) - n_words
    turn = [0x9E3779B97F4A7C15]
    for _ in range(words - 1):
        turn.append((turn[-1] * 0xD1342543DE82EF95 + 2) % 2**64)
    turn = np.array(turn, np.uint64)
    long = np.flatnonzero(np.arange(len(h)) - first[row] + words <= n_words[row]) if len(h) else np.zeros(0, np.int64)
    s = np.zeros(len(long), np.uint64)
    for j in range(words):
        s += h[long + j] * turn[j]
    short = np.flatnonzero((n_words > 0) & (n_words < words))
    t = np.zeros(len(short), np.uint64)
    for j in range(words - 1):
        has = n_words[short] > j
        t[has] += h[first[short[has]] + j] * turn[j]
    t += n_words[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    rows, values = np.concatenate([row[long], short]), mix(np.concatenate([s, t]))
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
    return values[new], np.bincount(rows[new], minlength=len(n_words)).astype(np.int64)


def per_set(values: np.ndarray, counts: np.ndarray, reduce) -> np.ndarray:
    """reduce.reduceat over each set; 0 for an empty one."""
    out = np.zeros(len(counts), values.dtype)
    some = counts > 0
    if some.any():
        out[some] = reduce.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def digests(values: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """16 bytes that name each set."""
    a = per_set(mix(values ^ np.uint64(0x5851F42D4C957F2D)), counts, np.add)
    b = per_set(mix(values + np.uint64(0x14057B7EF767814F)), counts, np.add) + counts.astype(np.uint64)
    raw = np.stack([mix(a), b], 1).astype(">u8").tobytes()
    return [raw[16 * i : 16 * i + 16] for i in range(len(counts))]


def signatures(values: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """(texts, n) least values of n hash functions, 32 bits each."""
    rng = np.random.default_rng(4242)
    out = np.empty((len(counts), n), np.uint32)
    for k in range(n):
        a, b = rng.integers(1, 2**63, 2, dtype=np.uint64)
        out[:, k] = per_set(((values * (a * np.uint64(2) + np.uint64(1)) + b) >> np.uint64(32)).astype(np.uint32), counts, np.minimum)
    return out


def signed(docs: DataFrame, spec: NearSpec) -> DataFrame:
    """doc_id, text_hash, n_shingles, node, signature of every row."""
    source = columns(docs, doc_id="bigint", text="string").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                values, counts = shingle_sets(batch.column("text"), spec.words)
                sig = signatures(values, counts, spec.bands * spec.rows)
                raw, size = sig.tobytes(), 4 * sig.shape[1]
                parts = [batch.column("doc_id"), batch.column("text_hash"), pa.array(counts), pa.array(digests(values, counts), pa.binary())]
                yield pa.RecordBatch.from_arrays([*parts, pa.array([raw[i * size : (i + 1) * size] for i in range(len(counts))], pa.binary())], ["doc_id", "text_hash", "n_shingles", "node", "signature"])

    return source.mapInArrow(run, "doc_id bigint, text_hash bigint, n_shingles bigint, node binary, signature binary")


def banded(nodes: DataFrame, spec: NearSpec) -> DataFrame:
    """(key, node): a row for each band."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, spec.bands, spec.rows).astype(np.uint64)
            key = np.zeros((n, spec.bands), np.uint64) + np.arange(spec.bands, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            for k in range(spec.rows):
                key = mix(key ^ (sig[:, :, k] + np.uint64(k << 40)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch.column("node").take(pa.array(np.repeat(np.arange(n), spec.bands)))], ["key", "node"])

    return nodes.select("node", "signature").mapInArrow(run, "key bigint, node binary")


def likely_forest(sig: np.ndarray, table: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(first, other) for the components of the pairs that no batch prunes: stars around their first rows."""
    edges, waiting, left, root = [], [], np.arange(len(sig)), 0
    while len(left):
        if waiting:
            at = waiting.pop()
        else:
            at, left = left[0], left[1:]
            root = int(at)
        alive, seen, agree = left, 0, np.zeros(len(left), np.int64)
        for n, least in table:
            agree = agree + (sig[alive, seen:n] == sig[at, seen:n]).sum(1)
            go = agree >= least
            alive, agree, seen = alive[go], agree[go], n
        if len(alive):
            edges += [(root, int(x)) for x in alive]
            waiting += alive.tolist()
            left = left[~np.isin(left, alive)]
    return edges


def likely_pairs(members: DataFrame, spec: NearSpec, parts: int) -> DataFrame:
    """(a, b) from buckets: members are (key, node, short), where short has a byte of each signature value."""
    table = pruning_table(spec)
    width = spec.bands * spec.rows

    def one(part: pa.Table) -> pa.Table:
        part = part.sort_by([("key", "ascending"), ("node", "ascending")])
        key, node = part["key"].to_numpy(), part["node"].to_pylist()
        sig = np.frombuffer(b"".join(part["short"].to_pylist()), np.uint8).reshape(len(key), width)
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(cut)
        edges = []
        two = cut[:-1][size == 2]
        ok = np.ones(len(two), bool)
        for n, least in table:
            ok[ok] = (sig[two[ok], :n] == sig[two[ok] + 1, :n]).sum(1) >= least
        edges += [(int(i), int(i) + 1) for i in two[ok]]
        for a, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
            edges += [(a + x, a + y) for x, y in likely_forest(sig[a : a + n], table)]
        edges = sorted({(node[x], node[y]) for x, y in edges})
        return pa.table({"a": pa.array([x for x, _ in edges], pa.binary()), "b": pa.array([y for _, y in edges], pa.binary())})

    return members.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts))).groupBy("part").applyInArrow(one, "a binary, b binary")


class SetGroup:
    """Full sets of some texts, for exact comparisons."""

    def __init__(self, texts: pa.ChunkedArray | pa.Array, spec: NearSpec):
        values, self.size = shingle_sets(texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, spec.words)
        _, self.ids = np.unique(values, return_inverse=True)
        self.end = np.cumsum(self.size)
        self.flag = np.zeros(int(self.ids.max()) + 1 if len(self.ids) else 0, np.int64)
        self.spec = spec

    def linked(self, at: int, others: np.ndarray) -> np.ndarray:
        """Those of `others` that link with `at`."""
        s, num, den = self.size, self.spec.numerator, self.spec.denominator
        others = others[(np.minimum(s[others], s[at]) * den >= np.maximum(s[others], s[at]) * num) & (s[others] > 0)]
        if not len(others) or not s[at]:
            return others[:0]
        own = self.ids[self.end[at] - s[at] : self.end[at]]
        self.flag[own] = 1
        n = s[others]
        first = np.cumsum(n) - n
        where = np.arange(int(n.sum())) + np.repeat(self.end[others] - n - first, n)
        both = np.add.reduceat(self.flag[self.ids[where]], first)
        self.flag[own] = 0
        return others[both * den >= (n + s[at] - both) * num]

    def forest(self, rows: np.ndarray) -> list[tuple[int, int]]:
        """(first, other) for the components of the links among `rows`, stars around their first rows; every pair of
        different components is compared."""
        edges, waiting, left, root = [], [], rows, 0
        while len(left):
            if waiting:
                at = waiting.pop()
            else:
                at, left = left[0], left[1:]
                root = int(at)
            found = self.linked(int(at), left)
            if len(found):
                edges += [(root, int(x)) for x in found]
                waiting += found.tolist()
                left = left[~np.isin(left, found)]
        return edges


def _edge_table(nodes: list, edges: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([nodes[x] for x, _ in edges], pa.binary()), "b": pa.array([nodes[y] for _, y in edges], pa.binary())})


def links_within(texts: DataFrame, spec: NearSpec) -> DataFrame:
    """Exact links (a, b), as a spanning forest, among the rows (task, part, node, text) of each part."""

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("part", "ascending"), ("node", "ascending")])
        sets, part = SetGroup(rows["text"], spec), np.unique(np.array(rows["part"].to_pylist(), dtype=object), return_inverse=True)[1]
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order])) + 1
        edges = [e for group in np.split(order, cuts) if len(group) > 1 for e in sets.forest(group)]
        return _edge_table(rows["node"].to_pylist(), edges)

    return texts.groupBy("task").applyInArrow(one, "a binary, b binary")


def links_across(sides: DataFrame, spec: NearSpec) -> DataFrame:
    """Exact links between rows (task, outside, node, root, text) of a task, outside ones with all of another
    root; once a root is linked to the outside one's, its other rows need no comparison."""

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("outside", "ascending"), ("node", "ascending")])
        sets, nodes = SetGroup(rows["text"], spec), rows["node"].to_pylist()
        root = np.unique(np.array(rows["root"].to_pylist(), dtype=object), return_inverse=True)[1]
        outside = rows["outside"].to_numpy()
        inner = np.flatnonzero(~outside)
        edges = []
        for at in np.flatnonzero(outside).tolist():
            found = sets.linked(at, inner[root[inner] != root[at]])
            for x in found:
                if root[x] != root[at]:
                    edges.append((at, int(x)))
                    root[root == root[x]] = root[at]
        return _edge_table(nodes, edges)

    return sides.groupBy("task").applyInArrow(one, "a binary, b binary")


def _big_links(big: DataFrame, spec: NearSpec) -> DataFrame:
    """(node, root) within groups above group_rows: `big` has grp, size, node, text."""
    chunks = F.ceil(F.col("size") / F.lit(spec.group_rows)).cast("bigint")
    big = kept(big.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks"))), "near-big")
    part = F.concat("grp", F.col("chunk").cast("string").cast("binary"))
    edges = kept(links_within(big.select(F.xxhash64("grp", "chunk").alias("task"), part.alias("part"), "node", "text"), spec), "near-chunk-links")
    # every chunk meets one member of its group's largest component so far: most components join here
    roots = components(edges, "near-chunk-roots")
    named = big.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = named.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("n"))
    top = heads.groupBy("grp", F.pmod(F.xxhash64("root"), F.lit(64)).alias("z")).agg(F.max(F.struct("n", "root")).alias("t")).groupBy("grp").agg(F.max("t").alias("t")).select("grp", F.col("t.root").alias("hub"))
    hub = top.join(big.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub").select("grp", "hub", "hub_text")
    first = named.select(F.xxhash64("grp", "chunk").alias("task"), F.lit(False).alias("outside"), "node", "root", "text")
    hubs = big.select("grp", "chunk").distinct().join(hub, "grp").select(F.xxhash64("grp", "chunk").alias("task"), F.lit(True).alias("outside"), F.col("hub").alias("node"), F.col("hub").alias("root"), F.col("hub_text").alias("text"))
    met = kept(links_across(first.unionByName(hubs), spec), "near-hub-links")
    edges = edges.unionAll(met)
    roots = kept(components(edges, "near-big-roots"), "near-big-roots")
    named = big.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = named.groupBy("grp", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = sizes.groupBy("grp").agg(F.max(F.struct("n", "root")).alias("t")).select("grp", F.col("t.root").alias("main"))
    named = kept(named.join(largest, "grp"), "near-big-named")
    out = named.where(F.col("root") != F.col("main"))
    n_out = out.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / F.lit(spec.group_rows)).cast("bigint").alias("lots"))
    if n_out.isEmpty():
        return roots
    lot = F.pmod(F.xxhash64("node", F.lit(1)), F.col("lots"))
    inner = named.join(n_out, "grp").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lots") - 1))).select(F.xxhash64("grp", "chunk", "lot").alias("task"), F.lit(False).alias("outside"), "node", "root", "text")
    outer = out.join(n_out, "grp").withColumn("lot", lot).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1))).select(F.xxhash64("grp", "chunk", "lot").alias("task"), F.lit(True).alias("outside"), "node", "root", "text")
    crossed = kept(links_across(inner.unionByName(outer), spec), "near-cross-links")
    return components(edges.unionAll(crossed), "near-big-roots")


def near_components(docs: DataFrame, spec: NearSpec = NearSpec()) -> tuple[DataFrame, DataFrame]:
    """(rows, names): `rows` has doc_id, text_hash, n_shingles, node of every document; `names` has for every
    node with words its component's root node and name (the least id in it)."""
    signs = kept(signed(docs, spec), "near-signs")
    rows = signs.select("doc_id", "text_hash", "n_shingles", "node")
    worded = signs.where("n_shingles > 0")
    classes = worded.groupBy("node").agg(F.min("doc_id").alias("id"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.max("signature").alias("signature"))
    nodes = kept(classes, "near-nodes")
    bands = banded(nodes, spec)
    counts = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("head")).where("c > 1")
    members = kept(bands.join(counts, "key"), "near-members")
    stars = members.where((F.col("c") > spec.bucket_rows) & (F.col("node") != F.col("head"))).select(F.col("head").alias("a"), F.col("node").alias("b"))
    small = members.where(F.col("c") <= spec.bucket_rows)
    # a byte of each value is enough to compare: other values agree in it once in 256 times, which only keeps more
    short = nodes.select("node", _low_bytes(F.col("signature"), spec).alias("short"))
    n_small = small.count()
    likely = likely_pairs(small.select("key", "node").join(short, "node"), spec, pieces(n_small, 1 << 14))
    groups = components(kept(stars.unionAll(likely).distinct(), "near-likely"), "near-groups").withColumnRenamed("root", "grp")
    groups = kept(groups, "near-groups")
    sized = groups.join(groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "grp")
    wanted = sized.join(nodes.select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")), "node")
    source = columns(docs, doc_id="bigint", text="string").withColumn("text_hash", F.xxhash64("text"))
    wanted = kept(wanted, "near-wanted")
    # only texts that a group may want are sent to it
    source = maybe_in(source, "text_hash", hash_set(wanted.select("rep_hash"), "rep_hash"), "wanted__").where("wanted__").drop("wanted__")
    found = wanted.join(source, (F.col("rep_hash") == F.col("text_hash")) & F.col("rep_id").eqNullSafe(F.col("doc_id")))
    texts = kept(found.select("grp", "size", "node", "text"), "near-texts")
    total = groups.count()
    task = F.pmod(F.xxhash64("grp"), F.lit(pieces(total, spec.group_rows)))
    within = texts.where(F.col("size") <= spec.group_rows).select(task.alias("task"), F.col("grp").alias("part"), "node", "text")
    roots = components(links_within(within, spec), "near-roots")
    big = texts.where(F.col("size") > spec.group_rows)
    if not big.isEmpty():
        roots = roots.unionAll(_big_links(big, spec))
    roots = kept(roots, "near-roots")
    rooted = nodes.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = rooted.select("root", "id").groupBy("root").agg(F.min("id").alias("component_id"))
    return rows, rooted.select("node", "root").join(names, "root")


def _low_bytes(signature, spec: NearSpec):
    """A byte of each 32-bit value of the signature."""
    n = spec.bands * spec.rows
    return F.concat(*[F.substring(signature, 4 * k + 1, 1) for k in range(n)])


def near_digest(docs: DataFrame, spec: NearSpec = NearSpec()) -> DataFrame:
    """A row for every document: set size, component and whether the document gives it its name."""
    rows, names = near_components(docs, spec)
    joined = rows.select("doc_id", "n_shingles", "node").join(names.select("node", "component_id"), "node", "left")
    name = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", name.alias("component_id"), F.coalesce(F.col("doc_id") == name, name.isNull()).alias("kept"))


def without_near_copies(docs: DataFrame, spec: NearSpec = STAGE) -> DataFrame:
    """`docs` with one row of each component, the one of least id (then least text hash); rows without words stay."""
    rows, names = near_components(docs, spec)
    wordy = rows.where("n_shingles > 0").join(names.select("node", "root"), "node")
    chosen = wordy.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")).alias("c"))
    id_, text_, flag = (free_name(docs, x) for x in ("near_id", "near_text", "near_flag"))
    each = kept(wordy.join(chosen, "root").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("c.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("c.text_hash") == F.col("text_hash"))).alias("stays")), "near-each")
    gone = each.where(~F.col("stays")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_text"))
    again = each.where(F.col("stays") & (F.col("n") > 1)).select("text_hash")  # rows that repeat both id and text
    # nearly all rows stay: only those that may go, or may be a repeat, are shuffled
    doubt = hash_set(gone.select(F.col("gone_text").alias("text_hash")).unionAll(again), "text_hash")
    own = [F.col(f"`{c}`") for c in docs.columns]
    tagged = docs.select(*own, F.col("doc_id").cast("bigint").alias(id_), F.xxhash64(F.col("text").cast("string")).alias(text_))
    wordless = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]")) == 0
    marked = maybe_in(tagged, text_, doubt, flag).withColumn(flag, F.col(flag) & ~wordless)
    left = marked.where(F.col(flag)).join(gone, (F.col(text_) == F.col("gone_text")) & F.col(id_).eqNullSafe(F.col("gone_id")), "left_anti")
    if not again.isEmpty():
        left = left.dropDuplicates([id_, text_])
    return marked.where(~F.col(flag)).select(*own).unionAll(left.select(*own))
