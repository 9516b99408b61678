"""Near duplicates, embeddings, substrings and components against brute force on small fixtures with every edge case."""

import random
from collections import Counter

import numpy as np
import pytest

from intronaut.llm import near_dedup, substring_dedup
from intronaut.operators.components import components
from intronaut.llm.embedding_dedup import calibrate, similar_vectors
from intronaut.llm.near_dedup import near_duplicates
from intronaut.llm.substring_dedup import remove_repeats

DOCS = "doc_id long, text string, rep string, u int, bucket string"


def least(nodes, pairs):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def words(rnd, n):
    return [f"w{rnd.randrange(5000)}" for _ in range(n)]


def documents():
    rnd, rows, i = random.Random(5), [], 10
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "a b c"), (7, "a b c d"), (8, "A  b\tc\nd"), (9, "É é É é"), (None, "a b c d"), (None, None)]
    for _ in range(12):  # groups of near copies, some chains
        base = words(rnd, rnd.choice([30, 80, 300]))
        for _ in range(rnd.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2, len(base) // 40])):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(99)}"
            rows.append((i, " ".join(copy)))
            base = copy if rnd.random() < 0.5 else base
            i += 1
    rows.append((i, " ".join(words(rnd, 30_000))))
    rows.append((i, rows[-1][1]))  # a repeated row
    rows.append((12, "a b c d e f g"))  # a repeated id with another text
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(a, b, "x", 1, "y") for a, b in documents()], DOCS).repartition(3)


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates_equal_brute_force(spark, docs, block, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = documents()
    sets = [(a, shingles(t, 4)) for a, t in rows]
    pairs = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y)]
    want = least({a for a, _ in rows if a is not None}, pairs)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.n_shingles) for r in got) == Counter((a, len(x)) for a, x in sets)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == want[r.doc_id])
        else:
            assert not r.kept


def test_near_duplicates_of_nothing(spark, docs):
    assert near_duplicates(docs.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    factors, salts = near_dedup._factors(near_dedup.SAMPLES)
    limit = near_dedup.odd_bits_limit(0.8)
    passed = []
    for _ in range(40):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
        x, y = (near_dedup.odd_sketch(near_dedup.minhash(np.concatenate([common, z]), factors), salts, near_dedup.SKETCH_BITS) for z in (a, b))
        passed.append(int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= limit)
    assert all(passed)


@pytest.mark.parametrize("few", [10_000, 0])
def test_components(spark, few):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(100, 140)] + [(rnd.randrange(300, 500), rnd.randrange(300, 500)) for _ in range(120)] + [(7, 7), (None, 3)]
    want = least({x for p in links if None not in p and p[0] != p[1] for x in p}, [p for p in links if None not in p and p[0] != p[1]])
    df = spark.createDataFrame(links, "u long, v long").repartition(5)
    assert {r.node: r.component for r in components(df, few).collect()} == want


def vectors():
    rng, rows, i = np.random.default_rng(3), [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            base = rng.normal(size=16)
            for _ in range(rng.choice([1, 1, 3])):
                rows.append((i, (base + rng.normal(size=16) * rng.choice([0, 0.05, 0.3]) * np.abs(base).mean()).tolist(), label))
                i += 1
    v = rows[0][1]
    rows += [(i, v, 0), (i + 1, v, None), (i + 2, None, 0), (i + 3, [], 0), (i + 4, [0.0] * 16, 0), (i + 5, [None, *v[1:]], 0), (i + 6, [float("nan"), *v[1:]], 0), (i + 7, [float("inf"), *v[1:]], 0), (i + 8, v[:4], 0), (None, v, 0), (i + 9, [1e200 * x for x in v], 0)]
    return rows


def test_similar_vectors_equal_brute_force(spark):
    rows = vectors()
    # ids that repeat, with the same vector, with others near it and with others far from it
    rows += [(9001, [1.0, 0.0, 0.0], 40), (9001, [0.99, 0.1, 0.0], 40), (9002, [0.98, 0.12, 0.0], 40), (9003, [0.0, 0.0, 1.0], 40), (9001, [0.0, 0.02, 1.0], 40), (9001, [1.0, 0.0, 0.0], 40), (9000, [0.0, 1.0, 0.0], 40), (9000, [0.0, 0.1, 1.0], 40)]
    good = [(n, np.array(v, float), c) for n, (k, v, c) in enumerate(rows) if k is not None and c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = [(n, v / np.abs(v).max(), c) for n, v, c in good]
    pairs = [(a, b) for k, (a, x, c) in enumerate(unit) for b, y, d in unit[:k] if c == d and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93]
    degree, group = Counter(x for p in pairs for x in p), least(set(range(len(rows))), pairs)
    first = {}
    for n, root in group.items():
        if rows[n][0] is not None:
            first[root] = min(first.get(root, rows[n][0]), rows[n][0])
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, cell string, key int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in similar_vectors(df).collect() if r.vec_id is not None)
    assert got == Counter((r[0], degree[n], first[group[n]], first[group[n]] == r[0]) for n, r in enumerate(rows) if r[0] is not None)
    assert similar_vectors(df).count() == len(rows) and similar_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("largest", [1, 100, 10_000, 10**8])
def test_calibration_stays_small(largest):
    bits, groups, _ = calibrate(largest, 0.93)
    assert groups < 400 and bits <= 40


def test_planted_links_are_found(spark):
    """Recall over thousands of vectors of one label, pairs planted just above the threshold."""
    rng, n, d = np.random.default_rng(11), 4000, 48
    base = rng.normal(size=(n, d))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=(n, d))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 0.95, n)[:, None]
    x = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side])
    linked = x @ x.T >= 0.93
    np.fill_diagonal(linked, False)
    rows = [(i, v.tolist(), 7) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), threshold=0.93).collect()}
    want = linked.sum(axis=1)
    assert want.sum() >= 2 * n and all(got[i] <= want[i] for i in range(2 * n))
    assert sum(got.values()) >= 0.999 * want.sum()


def removed(rows, width):
    split = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[j : j + width]) for w in split for j in range(len(w) - width + 1))
    out = []
    for (a, _), w in zip(rows, split, strict=True):
        gone = set()
        for j in range(len(w) - width + 1):
            if seen[tuple(w[j : j + width])] > 1:
                gone |= set(range(j, j + width))
        out.append((a, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return Counter(out)


@pytest.mark.parametrize(("width", "chunk", "hot"), [(35, 1 << 20, 5_000), (35, 700, 1), (35, 1 << 20, 1), (3, 4000, 2), (1, 1 << 20, 3)])
def test_repeats_equal_brute_force(spark, width, chunk, hot, monkeypatch):
    """Also with texts in pieces of less than a kilobyte, and with nearly all symbols hot."""
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(substring_dedup, "LEAST_HOT", hot)
    rnd = random.Random(9)
    passage, rows = words(rnd, 60), [(1, None), (2, ""), (3, "a b"), (None, "lonely text here")]
    for i in range(10, 40):
        w = words(rnd, rnd.choice([5, 40, 200]))
        if i % 3 == 0:
            lo, hi = rnd.randrange(0, 20), rnd.randrange(40, 61)
            w[rnd.randrange(len(w)) :] = passage[lo:hi] + words(rnd, 3)
        rows.append((i, "\n".join(w)))
    rows += [(50, "of the " * 100), (51, "x " + "of the " * 40), (52, " ".join(passage)), (52, " ".join(passage)), (52, " ".join(words(rnd, 90))), (53, "same " * 34), (54, "Same " * 35), (55, " ".join(words(rnd, 20_000))), (56, "  é b \x0b" + " ".join(passage[:35]))]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, symbol int, ranges string").repartition(4)
    got = remove_repeats(df, width).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == removed(rows, width)
    assert all(sum(s.high - s.low for s in r.removed_spans) == r.n_removed for r in got)


def test_repeats_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="window"):
        remove_repeats(spark.createDataFrame([], "doc_id long, text string"), 0)
