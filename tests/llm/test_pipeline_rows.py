"""Stages of the pipeline against brute force, on rows with repeated and null ids, null texts, long texts and clashing names."""

import random
from collections import Counter

import corpus_pipeline
import pytest

from intronaut.llm import words as kernels

#: Names that stages or operators give to columns of their own.
CLASHES = ("row_key", "row", "key", "kept", "bad", "toxicity_score", "score", "n_removed", "ranges", "copy", "size", "at", "d")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def texts(n, words):
    rnd = random.Random(3)
    return [" ".join(f"w{rnd.randrange(5000)}" for _ in range(words)) for _ in range(n)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *(f"{c}-{i}" for c in CLASHES)) for i, t, s in rows], DOCS).repartition(parts)


def rows_of(df):
    rows = df.collect()
    assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHES)
    assert all(r.n_chars == len(r.text or "") for r in rows)
    return Counter((r.doc_id, r.text, r.source) for r in rows)


@pytest.fixture
def cases(spark, tmp_path):
    a, b, c, d, item, e = texts(6, 60)
    bad = "utter filth and rot"
    rows = [(1, a, "s"), (1, a, "s"), (2, a + " one more", "t"), (None, a, None), (None, b, "s"), (None, c, "s"), (None, c, "t"), (5, d, "s"), (5, f"{bad} {e}", "s"), (6, None, None), (None, "", "t"), (7, item, "s"), (None, item, "t"), (8, f"x y {item} z", "t"), (9, " ".join(texts(1, 60_000)), "s"), (10, bad, "s")]
    labels = [(k, int(k % 2)) for k in range(100, 160)] + [(None, 1), (1, None)]
    rows += [(k, f"{bad} {k}" if t else f"fine words {k}", "u") for k, t in labels[:-2]]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (None, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, str(tmp_path), bad


def test_toxic_rows_go(spark, cases):
    rows, sf, bad = cases
    docs = frame(spark, rows)
    kept = corpus_pipeline.toxicity(spark, docs, sf)
    assert kept.columns == docs.columns
    assert rows_of(kept) == Counter(r for r in rows if not (r[1] or "").startswith(bad))
    assert corpus_pipeline.toxicity(spark, docs.limit(0), sf).count() == 0


def test_dedup_keeps_one_row_of_each_group(spark, cases):
    rows, sf, _ = cases
    docs = frame(spark, rows)
    kept = corpus_pipeline.minhash_dedup(spark, docs, sf)
    assert kept.columns == docs.columns

    def shingles(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets, group = [shingles(t) for _, t, _ in rows], list(range(len(rows)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and 100 * len(x & y) >= 80 * len(x | y):
                group = [group[j] if g == group[i] else g for g in group]
    found = rows_of(kept)
    for g in set(group):
        members = [rows[i] for i in range(len(rows)) if group[i] == g]
        first = min(members, key=lambda r: (r[0] is None, r[0] or 0))
        stay = sum(found[r] for r in set(members))
        assert stay == 1 and sum(found[r] for r in set(members) if r[0] == first[0]) == 1
    assert sum(found.values()) == len(set(group))
    # a repeated row is no repeated passage any more
    assert rows_of(corpus_pipeline.substring_dedup(spark, kept.where("doc_id = 1"), "")).total() == 1


@pytest.mark.parametrize("chunk", [1 << 20, 5_000])
def test_repeated_passages_go(spark, cases, chunk, monkeypatch):
    rows, sf, _ = cases
    from intronaut.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", chunk)
    docs = frame(spark, rows)
    kept = corpus_pipeline.substring_dedup(spark, docs, sf)
    assert kept.columns == docs.columns
    split = [(t or "").split() for _, t, _ in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = Counter()
    for (i, t, s), w in zip(rows, split, strict=True):
        gone = {k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        want[(i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t, s)] += 1
    assert rows_of(kept) == want
    assert corpus_pipeline.substring_dedup(spark, docs.limit(0), sf).count() == 0


def test_decontamination_goes_by_row(spark, cases):
    rows, sf, _ = cases
    docs = frame(spark, rows, 2)
    left = corpus_pipeline.decontamination(spark, docs, sf)
    assert left.columns == docs.columns
    assert rows_of(left) == Counter(r for r in rows if r[0] not in (7, 8) and not (r[0] is None and r[1] == rows[11][1]))
    assert corpus_pipeline.decontamination(spark, docs.limit(0), sf).count() == 0


def test_mix_emits_the_copies_of_each_row(spark, cases):
    rows, sf, _ = cases
    rows = rows + [(1, rows[0][1], "t")] * 30
    docs = frame(spark, rows)
    mixed = corpus_pipeline.mixing(spark, docs, sf)
    assert mixed.columns == [*docs.columns, "copy_"]
    found = rows_of(mixed)
    assert set(found) <= set(rows)
    size = lambda t: len((t or "").split())
    own = {s: sum(size(t) for _, t, x in rows if x == s) for s in ("s", "t", "u", None)}
    weight, goal, capped = {"s": 5, "t": 2, "u": 1, None: 5}, {}, set()
    while True:  # in turn, as the contract says it
        left = sum(own.values()) - sum(3 * own[s] for s in capped)
        goal = {s: 3 * own[s] if s in capped else left * weight[s] / sum(weight[x] for x in own if x not in capped) for s in own}
        over = {s for s in own if goal[s] > 3 * own[s]}
        if not over:
            break
        capped |= over
    for s in own:
        n, taken = sum(x == s for _, _, x in rows), sum(k for (_, _, x), k in found.items() if x == s)
        rate = goal[s] / own[s]
        assert abs(taken - rate * n) <= 1
        for r in {r for r in rows if r[2] == s}:
            times = sum(x == r for x in rows)
            assert times * int(rate) <= found[r] <= times * min(3, int(rate) + 1)
    assert corpus_pipeline.mixing(spark, docs.limit(0), sf).count() == 0


def test_long_texts_have_the_features_of_their_pieces(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from intronaut.llm import toxicity

    column = pa.array([*texts(3, 700), "", None, "one"])
    model = toxicity.Model(-1.0, np.arange(0, 1 << 20, 3), np.full(len(range(0, 1 << 20, 3)), 0.01))
    whole, scores = list(toxicity.feature_sets(column)), toxicity.score_column(model, column)
    sets = list(kernels.shingle_sets(column, 4))
    split = kernels.split_words
    monkeypatch.setattr(toxicity, "split_words", lambda *a, **k: split(*a, **k, chunk=500))
    monkeypatch.setattr(kernels, "split_words", lambda *a, **k: split(*a, **k, chunk=500))
    assert all((a == b).all() for a, b in zip(whole, toxicity.feature_sets(column), strict=True))
    assert (scores == toxicity.score_column(model, column)).all()
    assert all((a == b).all() for a, b in zip(sets, kernels.shingle_sets(column, 4), strict=True))
