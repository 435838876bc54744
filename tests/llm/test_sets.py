"""Near duplicates, nearest neighbours, mixing, packing, fingerprints and language-model scores."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerframe.llm import ann_forest as ann
from ledgerframe.llm import components as comp
from ledgerframe.llm import mixing as mix
from ledgerframe.llm import near_dedup as near
from ledgerframe.llm import packing
from ledgerframe.llm import phrase_prints as prints
from ledgerframe.llm import ppm
from ledgerframe.llm import queries as q

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \t\n", "a", "one two three", "One two  three", "Ünïcode ſ K wörds <|endoftext|> x", "\x00\x0b\x85 ", "the " * 3000, "x" * 30_000]


def docs_of(spark, texts, extra=False):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({"score": F.lit("x"), "node": F.lit(1), "block": F.lit(None).cast("string"), "row": F.lit(2)}) if extra else df


def empty(spark):
    return spark.createDataFrame([], DOCS)


# near duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts, least=85):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


def variants(rng, groups=12, each=9, words=120, vocabulary=3000):
    out = []
    for _ in range(groups):
        base = [f"w{x}" for x in rng.integers(0, vocabulary, words)]
        for _ in range(each):
            w = list(base)
            for _ in range(int(rng.integers(0, 5))):
                w[int(rng.integers(0, len(w)))] = f"v{rng.integers(0, 10**6)}"
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("spec", [near.NearSpec(), near.NearSpec(bucket_rows=4, group_rows=4), near.NearSpec(bucket_rows=2, group_rows=3)])
def test_components_by_brute_force(spark, spec):
    rng = np.random.default_rng(5)
    texts = [*ODD, *ODD, *variants(rng), " ".join(f"w{i}" for i in range(50))]
    got = sorted(map(tuple, near.near_digest(docs_of(spark, texts, extra=True), spec).collect()))
    assert got == brute_components(texts)


def test_near_rows_without_ids_and_with_repeats(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(7, text, "a", "b", 1), (7, text, "a", "b", 1), (None, text, "a", "b", 1), (None, "lonely words stand here now", "a", "b", 1), (9, None, "a", "b", 1)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted(map(tuple, near.near_digest(df).collect()), key=str)
    assert got == sorted([(7, 36, 7, True), (7, 36, 7, True), (None, 36, 7, False), (None, 1, None, True), (9, 0, 9, True)], key=str)
    left = near.without_near_copies(df)
    assert left.columns == df.columns and sorted([r.doc_id for r in left.collect()], key=str) == [7, 9, None]
    assert near.near_digest(empty(spark)).count() == 0 and near.without_near_copies(empty(spark)).count() == 0


def test_stage_takes_copies_from_four_fifths(spark):
    base = [f"w{i}" for i in range(104)]
    near_copy, far_copy = list(base), list(base)
    for i in (20, 60):
        near_copy[i] = "other"  # 90 of 110 shingles are shared: 0.818
    for i in (20, 50, 80):
        far_copy[i] = "else"  # 85 of 115: 0.739
    texts = [" ".join(x) for x in (base, near_copy, far_copy)]
    sets = [shingles(t) for t in texts]
    alike = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
    assert 0.8 <= alike[0] < 0.85 and alike[1] < 0.8
    left = corpus_pipeline.near_dedup(spark, docs_of(spark, texts), "")
    assert sorted(r.doc_id for r in left.collect()) == [0, 2]
    assert all(r.kept for r in near.near_digest(docs_of(spark, texts)).collect())
    for spec in (near.NearSpec(), near.STAGE):
        assert (1 - spec.threshold**spec.rows) ** spec.bands < 4.3e-7 and spec.bands * spec.rows % spec.batch == 0


def test_pruning_bound():
    for n, least in near.pruning_table(near.NearSpec()):
        assert 0 < least <= n * 0.85


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=6, deadline=None)
def test_star_contraction(spark, edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.root for r in comp.components(df, "test").collect()} == {x: find(x) for x in list(root)}


# nearest neighbours


def brute_nearest(ids, x, every, k):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def test_recall(spark, data):
    p = spark.read.parquet(f"{data}/embeddings.parquet").toPandas()
    x, ids = np.stack(p.embedding.values).astype(float), p.vec_id.values
    more = np.random.default_rng(0).standard_normal((3000, x.shape[1]))
    x, ids = np.concatenate([x, more / np.linalg.norm(more, axis=1, keepdims=True)]), np.concatenate([ids, 10_001 + np.arange(3000)])
    df = spark.createDataFrame([(int(i), [float(y) for y in v], 0) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int")
    want, got = brute_nearest(ids, x, 100, 10), collections.defaultdict(list)
    for r in ann.search(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    hits = np.mean([len({i for i, _ in got[k]} & {i for i, _ in want[k]}) / 10 for k in want])
    assert hits >= 0.9
    exact = {(k, i): s for k in got for i, s in got[k]}
    pos = {int(i): n for n, i in enumerate(ids)}
    assert all(abs(s - math.sqrt(((x[pos[k]] - x[pos[i]]) ** 2).sum())) < 1e-12 for (k, i), s in exact.items())


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [1.0]), (None, [1.0, 1.0]), (100, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("query", F.lit("x"))
    got = [tuple(r) for r in ann.search(df).orderBy("query_id", "rank").collect()]
    assert [g[:3] for g in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (0, 4, 3), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 3)]
    assert ann.search(df.limit(0)).count() == 0
    many = spark.range(0, 3000).select(F.col("id").alias("vec_id"), F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    hot = ann.search(many).where("query_id = 200").orderBy("rank").collect()
    assert [r.vec_id for r in hot] == list(range(10)) and all(r.score == 0 for r in hot)


def test_candidates_are_few_and_of_the_longest_prefixes():
    x = np.random.default_rng(3).standard_normal((3000, 32))
    spec = ann.ForestSpec(trees=48)
    turned, center = ann.rotations(x, 32, spec)
    forest = ann.Forest(x, turned, center)
    wanted = spec.wanted(3000, 3000)
    h = forest.strings(x)
    for i, found in enumerate(forest.candidates(x[:20], wanted)):
        assert i in found and wanted <= len(found) < wanted + 3000 // 8 and len(found) < 1500
        same = [next((k for k in range(ann.SYMBOLS, -1, -1) if (h[:, i] // forest.base ** (ann.SYMBOLS - k) == h[:, j] // forest.base ** (ann.SYMBOLS - k)).any()), 0) for j in range(3000)]
        longest = np.array(same)
        left_out = np.setdiff1d(np.arange(3000), found)
        assert longest[left_out].max() <= longest[found].min() + 1  # one level at a time
    assert [len(f) for f in ann.Forest(x[:5], turned, center).candidates(x[:2], 11)] == [5, 5]


def test_an_id_with_several_vectors_counts_by_the_nearest(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.0, 5.0]), (7, [1.0, 0.5]), (8, [3.0, 0.0])], "vec_id long, embedding array<double>")
    assert [tuple(r)[1:] for r in ann.search(df).orderBy("rank").collect()] == [(1, 7, 0.5), (2, 8, 2.0)]


# mixing


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=12), st.floats(0, 1))
@settings(max_examples=60, deadline=None)
def test_fit_is_the_best_reachable(counts, share):
    total = sum(x * n for x, n in counts.items())
    budget = int(total * share)
    got = mix.fit(counts, budget, 10**6)
    assert all(0 < n <= counts[x] for x, n in got.items())
    reach = {0}
    for x, n in counts.items():
        reach = {r + x * k for r in reach for k in range(n + 1)}
    best = max(r for r in reach if r <= budget)
    # the proportional part is fixed first, so only the rest is fitted; it never lies further off than a length
    assert best - min(counts) * 3 - max(counts) <= sum(x * n for x, n in got.items()) <= budget


def test_targets():
    spec = mix.MixSpec()
    got = mix.targets([100, 100, 100], spec)
    assert got == [200.0, 250 * 2 / 3, 250 / 3] and abs(sum(got) - 450) < 1e-9
    assert mix.targets([0, 10], spec)[0] == 0 and mix.targets([], spec) == []


def test_mix_digest(spark):
    rng = np.random.default_rng(3)
    texts = [*ODD, *(" ".join("w" * int(n)) for n in rng.integers(1, 60, 400)), *["same words here"] * 300]
    df = docs_of(spark, texts, extra=True)
    rows = mix.mix_digest(df).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix.mix_digest(df.repartition(3)).collect()))
    sources = {i: f"s{i % 3}" if i % 4 else None for i in range(len(texts))}
    by = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or ""))
        assert r["size"] == n and r.taken <= 2 * n and r.taken % max(n, 1) == 0
        b = by[sources[r.doc_id]]
        b[0], b[1], b[2] = b[0] + n, b[1] + r.taken, r.target
    names = sorted([s for s in by if s is not None]) + [None]
    assert [by[s][2] for s in names] == pytest.approx(mix.targets([by[s][0] for s in names], mix.MixSpec()))
    assert all(abs(by[s][1] - by[s][2]) <= 1 for s in names)
    mixed = mix.mix_rows(df)
    assert mixed.columns == df.columns and mixed.where(F.regexp_count("text", F.lit(r"[^ \t\n]+")) > 0).count() == sum(r.taken // r["size"] for r in rows if r["size"])
    assert mix.mix_digest(empty(spark)).count() == 0


# packing


@given(st.lists(st.integers(1, 40), min_size=1, max_size=14), st.integers(5, 60))
@settings(max_examples=80, deadline=None)
def test_closest_fill_is_optimal(lengths, capacity):
    counts = [0] * 64
    for x in lengths:
        counts[x] += 1
    used = packing.closest_fill(list(counts), capacity)
    reach = {0}
    for x in lengths:
        reach |= {r + x for r in reach if r + x <= capacity}
    assert sum(x * n for x, n in used.items()) == max(reach) and all(n <= counts[x] for x, n in used.items())


def test_pack_round_trip(spark):
    from tokenizers import Tokenizer

    path = packing.default_files()[0]
    exact = Tokenizer.from_file(path)
    rng = np.random.default_rng(4)
    texts = [*ODD, *(" ".join(f"word{x}" for x in rng.integers(0, 500, int(n))) for n in rng.integers(1, 900, 120))]
    df = docs_of(spark, texts, extra=True)
    rows = packing.pack(df, with_ids=True).collect()
    docs, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        want = [*exact.encode(t or "", add_special_tokens=False).ids, 0]
        got = b"".join(r.ids for r in sorted(docs[i], key=lambda r: r.start))
        assert np.frombuffer(got, "<u4").tolist() == want and all(r.doc_tokens == len(want) for r in docs[i])
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(seqs) <= -(-total // 1024) + 2  # few remainders may be cut here
    assert packing.pack(empty(spark)).count() == 0


# fingerprints


def test_compare_with_next(spark):
    rng = np.random.default_rng(6)
    words_ = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(2000)]
    texts = [*ODD, *(" ".join(rng.choice(words_, int(n))) for n in rng.integers(200, 500, 60))]
    texts += [texts[12], texts[13]]
    rows = prints.compare_with_next(docs_of(spark, texts, extra=True), prints.PrintSpec(block_rows=16)).orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    prints_of = collections.defaultdict(set)
    for i, r in enumerate(rows):
        t, nxt = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edit = t[: len(t) - half] + nxt[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        prints_of[t].add(r.fingerprint)
        prints_of[edit].add(r.edited_fingerprint)
        if len(t) > 1000 and 10 <= i < 68:
            assert 0.15 < r.near_edited < 0.75 and r.near_next < 0.1
    assert all(len(x) == 1 for x in prints_of.values())
    single = prints.compare_with_next(docs_of(spark, ["only one text"])).first()
    assert single.near_next == 1.0 and prints.compare_with_next(empty(spark)).count() == 0


def test_parse_is_locally_consistent():
    rng = np.random.default_rng(7)
    core = rng.integers(97, 123, 3000).astype(np.uint8).tobytes().decode()
    texts = ["x" * k + rng.integers(97, 123, 5 + 7 * k).astype(np.uint8).tobytes().decode() + core for k in range(6)]
    symbols, at = prints.text_buffer(pa.array(texts))
    for _ in range(3):
        symbols, at = prints.parse(symbols, at)
    sets = [set(symbols[a:b].tolist()) for a, b in zip(at, at[1:])]
    for s in sets[1:]:
        assert len(s & sets[0]) > 0.9 * len(sets[0])


def test_equal_texts_equal_prints_whatever_stands_beside():
    alone = [prints.told(prints.fingerprints(pa.array([t]), prints.PrintSpec())[0]) for t in ("", "a", "abc abc abc", "aaaa", "the quick brown fox")]
    together = [prints.told(x) for x in prints.fingerprints(pa.array(["", "a", "abc abc abc", "aaaa", "the quick brown fox", "zz" * 400]), prints.PrintSpec())]
    assert together[:5] == alone and len(set(alone)) == 5


def test_short_texts_share_names_of_the_level_below():
    rng, spec = np.random.default_rng(8), prints.PrintSpec()
    text = lambda n: rng.integers(97, 123, n).astype(np.uint8).tobytes().decode()
    kept = [text(30) for _ in range(200)]
    first, second, other = ([k + text(25) for k in kept], [k + text(25) for k in kept], [text(55) for _ in kept])
    found = [prints.fingerprints(pa.array(x), spec) for x in (first, second, other)]
    near, far = ([prints.likeness(a, b, spec.sketch) for a, b in zip(found[0], f)] for f in found[1:])
    assert np.mean(np.array(near) == 0) < 0.05 and np.mean(near) > 0.2 and np.mean(far) < 0.02
    for a, b, t in zip(found[0], found[1], first):  # by sets, and the text form holds both kinds
        if len(a[1]) < spec.few and len(b[1]) < spec.few:
            x, y = ({*p[1].tolist(), *p[2].tolist()} for p in (a, b))
            assert len(a[2]) and prints.likeness(a, b, spec.sketch) == len(x & y) / len(x | y)
            assert [len(p) for p in prints.told(a).split(":")] == [16, 8 * len(a[1]), 8 * len(a[2])]
    long = prints.fingerprints(pa.array([text(4000)]), spec)[0]
    assert not len(long[2]) and prints.told(long).count(":") == 1


# language-model scores


def brute_base(texts):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)), None]
    c = collections.Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(tokens(t))
    n, v = sum(c.values()), len(c)
    return n, [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for t in texts]


def brute_ppm(train, text, order):
    """PPM of one text by counting in dictionaries, with the same escape estimates."""
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        b = bytes([ppm.BEGIN] * order) + (t or "").translate(LOWER).encode() + bytes([ppm.END])
        for p in range(order, len(b)):
            for j in range(order + 1):
                counts[b[p - j : p]][b[p]] += 1
    keys = np.concatenate([ppm.windows(pa.array([t], pa.string()), order)[0] for t in train])
    u, c = ppm.distinct(keys)
    low = ppm.merged([u & np.uint64((1 << 24) - 1)], [c])
    escapes = ppm.escape_table(ppm.Trie(order, u, c, low).tally(u, c))
    lev = lambda x: int(ppm.level(np.array([x]))[0])

    def below(b, p, symbol):
        total, excluded, after = 0.0, set(), 0
        for j in range(order, -1, -1):
            seen = counts.get(b[p - j : p])
            if not seen:
                continue
            left = {s: n for s, n in seen.items() if s not in excluded}
            n, t = sum(left.values()), len(left)
            if n:
                e = escapes[j, after, lev(n), lev(t)]
                if symbol in left:
                    return total + math.log10((1 - e) * left[symbol] / n)
                total += math.log10(e)
            excluded, after = set(seen), 1
        return total - math.log10(256 - len(excluded))

    def foretold(text):
        b = bytes([ppm.BEGIN] * ppm.FAR) + (text or "").translate(LOWER).encode() + bytes([ppm.END])
        last, run = {}, 0
        for p in range(ppm.FAR, len(b)):
            told = last.get(b[p - ppm.FAR : p])
            yield p - ppm.FAR, b[p], told if told is not None and run >= 4 else None, min(round(2 * math.log2(max(run, 1))), ppm.RUNS - 1)
            run = run + 1 if told == b[p] else 0
            last[b[p - ppm.FAR : p]] = b[p]

    runs = np.zeros((ppm.RUNS, 2))
    for t in train:
        for _, symbol, told, level in foretold(t):
            if told is not None:
                runs[level, int(told == symbol)] += 1
    away = (runs[:, 0] + 1) / (runs.sum(1) + 2)
    b = bytes([ppm.BEGIN] * order) + (text or "").translate(LOWER).encode() + bytes([ppm.END])
    total = 0.0
    for p, symbol, told, level in foretold(text):
        if told is None:
            total += below(b, p + order, symbol)
        elif told == symbol:
            total += math.log10(1 - away[level])
        else:
            total += math.log10(away[level]) + below(b, p + order, symbol) - math.log10(max(1 - 10 ** below(b, p + order, told), 1e-12))
    return total


def test_scores_by_brute_force(spark):
    rng = np.random.default_rng(8)
    syllables = ["ba", "ko", "ri", "tha", "nen"]
    texts = [*ODD[:8], *(" ".join("".join(rng.choice(syllables, int(k))) for k in rng.integers(1, 4, 30)) for _ in range(40)), "the " * 50, "abc def ghi jkl. " * 6 + "abc def ghx jkl. " * 2]
    got = sorted(ppm.ppm_scores(docs_of(spark, texts, extra=True), ppm.PpmSpec(order=4, block_chars=700)).collect(), key=lambda r: r.doc_id)
    n, base = brute_base(texts)
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    for r, t, (tokens, known, score) in zip(got, texts, base):
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n) and r.base_score == pytest.approx(score)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
    for i in (0, 3, 4, 6, 7, 12, 20, 30, 48, 49):
        assert got[i].score == pytest.approx(brute_ppm(train, texts[i], 4), rel=1e-5)
    assert ppm.ppm_scores(empty(spark)).count() == 0


def test_probabilities_sum_to_one():
    keys = np.concatenate([ppm.windows(pa.array(["abracadabra", "banana bread"]), 3)[0]])
    u, c = ppm.distinct(keys)
    trie = ppm.Trie(3, u, c, ppm.merged([u & np.uint64((1 << 24) - 1)], [c]))
    escapes = ppm.escape_table(trie.tally(u, c))
    for context in (b"abr", b"zzz", b"ana", b"\xfe\xfe\xfe"):
        q_ = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** trie.log10(q_, escapes)).sum() == pytest.approx(1.0)


def test_untrained_model(spark):
    only = [i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1][0]
    df = spark.createDataFrame([(only, "ab", "en", "s", 2)], DOCS)
    r = ppm.ppm_scores(df).first()
    assert r.train_tokens == 0 and r.score == pytest.approx(-3 * math.log10(256)) and r.base_score == 0


# pipeline


def test_pipeline(spark, data):
    out = corpus_pipeline.run(spark, data)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
    docs = spark.read.parquet(f"{data}/documents.parquet").withColumns({"score": F.lit(1.5), "near_id": F.lit("q"), "row": F.lit(True)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, data)
        assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes), name
        assert stage(spark, docs.limit(0), data).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mixing", "packing"]


def pipeline_corpus():
    """Texts of random words: near copies of four degrees, exact copies, toxic ones, ones with a secret, and odd ones."""
    rng = np.random.default_rng(11)
    texts = variants(rng, groups=25, each=6, words=60)
    texts += texts[:12]
    clean = [" ".join(f"w{x}" for x in rng.integers(0, 3000, int(n))) for n in rng.integers(8, 90, 120)]
    insults = ["scum", "vermin", "worthless", "idiot", "pathetic", "disgusting"]
    toxic = [f"{a} you {' '.join(rng.choice(insults, 4))} {b}" for a, b in zip(clean[:60], clean[60:])]
    secret = [f"{t} password: hunter{i}xyz and AKIA{i:016d}ABCD end" for i, t in enumerate(clean[:20])]
    return [*texts, *clean, *toxic, *secret, None, "", " "], range(len(texts) + len(clean), len(texts) + len(clean) + len(toxic))


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against a brute-force form of it, on what the stage before gave."""
    texts, toxic = pipeline_corpus()
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages, got = dict(corpus_pipeline.STAGES), {}
    for name, stage in stages.items():
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        got[name] = docs.collect()
    by_id = {name: {r.doc_id: r for r in rows} for name, rows in got.items()}

    assert sorted(by_id["toxicity"]) == [i for i in range(len(texts)) if i not in toxic] and len(got["toxicity"]) == len(by_id["toxicity"])

    left = sorted(by_id["toxicity"])
    alone = [left[i] for i, n, _, first in brute_components([texts[i] for i in left], least=80) if first or not n]
    assert sorted(r.doc_id for r in got["near_dedup"]) == alone and len(alone) < len(left) - 20

    base = re.compile(r"hunter\d+xyz|AKIA[A-Z0-9]{16,}")  # of this corpus
    for i in alone:
        text = by_id["secrets"][i].text
        assert (text is None) == (texts[i] is None) and not base.search(text or "")
        parts = re.split(r"(?:password: )?(?:hunter\d+xyz|AKIA[A-Z0-9]+)", texts[i] or "")
        assert [x.strip() for x in re.split(r"(?:password: )?\[secret\]", text or "")] == [x.strip() for x in parts]
    assert sorted(r.doc_id for r in got["secrets"]) == alone

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    has, takes = collections.Counter(), collections.Counter()
    for r in got["secrets"]:
        has[r.source] += size(r.text)
    for r in got["mixing"]:
        takes[r.source] += size(r.text)
        assert r.text == by_id["secrets"][r.doc_id].text
    names = [*sorted(x for x in has if x is not None), None]
    for name, target in zip(names, mix.targets([has[x] for x in names], mix.MixSpec())):
        assert abs(takes[name] - target) <= 1
    copies = collections.Counter(r.doc_id for r in got["mixing"])
    assert max(copies.values()) <= 2 and set(copies) <= set(alone)

    encode = packing.whole_file(packing.default_files()[0]).encode
    ids = {i: np.array([*encode(by_id["secrets"][i].text or "", add_special_tokens=False).ids, 0], "<u4") for i in copies}
    cover, fills = collections.Counter(), collections.defaultdict(list)
    for r in got["packing"]:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and zlib.crc32(own.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        cover.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        fills[r.sequence_id].append((r.offset, r.length))
    assert cover == {(i, k): n for i, n in copies.items() for k in range(len(ids[i]))}
    for pieces in fills.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [o for o, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_queries_are_registered():
    assert [m[1] for n in q.QUERIES if (m := re.match(r"op(\d+)_", n))] == [str(i) for i in range(1, 11)]
