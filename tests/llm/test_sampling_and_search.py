"""Importance resampling, secret scans and hard negatives against brute force, and their edge cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from hashlib import sha256
from intronaut.llm import hard_negatives as hn
from intronaut.llm import importance, secret_scan, words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, n):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(w), [b" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def resampled(docs, target, n, buckets, percent, least):
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in features(t, n)[1])
    s, t = count(x for _, x in docs), count(target)
    every_s, every_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * (every_s + buckets) / (float(s[b] + 1) * (every_t + buckets))))
    rows = []
    for i, text in docs:
        size, found = features(text, n)
        weight, score = sum(gain(zlib.crc32(f) % buckets) for f in found), None
        if i is not None:
            h = int(sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, size, len(found), weight, score))
    fit = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0], -r[2], r[3]))
    drawn = [(*r, k + 1) for k, r in enumerate(fit[: len(fit) * percent // 100])]
    return Counter([*drawn, *((*r, None) for r in fit[len(drawn) :]), *((*r, None) for r in rows if r[1] < least or r[4] is None)])


@pytest.mark.parametrize("n", [1, 3])
def test_resampling_equals_brute_force(spark, n, monkeypatch):
    monkeypatch.setattr(words, "CHUNK_BYTES", 4096)
    rnd = random.Random(n)
    text = lambda size: " ".join(rnd.choice(["Ab", "é", "c9", "x-y", "q" * 90, f"w{rnd.randrange(300)}"]) for _ in range(size))
    docs = [(i, text(rnd.randrange(60))) for i in range(150)] + [(900, None), (901, ""), (902, "?! "), (None, text(40)), (903, text(30_000)), (904, "solid" * 5000)]
    docs += [(905, "same words " * 12)] * 3 + [(906, docs[0][1]), (905, "other words " * 12)]
    target = [text(40) for _ in range(9)] + [None, ""]
    frames = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, weight string, block int").repartition(3), spark.createDataFrame([(x, 4) for x in target], "text string, doc_id int")
    run = lambda d, t: Counter(map(tuple, importance.resample(d, t, n, 997, 30, 20, seed=7).collect()))
    assert run(*frames) == resampled(docs, target, n, 997, 30, 20)
    assert run(frames[0].limit(0), frames[1]) == Counter()
    assert run(frames[0], frames[1].limit(0)) == resampled(docs, [], n, 997, 30, 20)


def test_long_rows_are_counted_in_pieces(spark):
    """A row of several chunks: runs across the borders of pieces are counted once."""
    text = " ".join(f"v{i % 7919}" for i in range(400_000))
    blocks = importance.csr_blocks(spark.createDataFrame([(1, "a b"), (2, text), (3, "c")], "doc_id long, text string").coalesce(1), 2, 500).collect()
    assert [tuple(b.doc_id) for b in blocks] == [(1,), (2,), (3,)] and [b.n_words[0] for b in blocks] == [2, 400_000, 1]
    want = Counter(zlib.crc32(f) % 500 for f in features(text, 2)[1])
    assert dict(zip(blocks[1]["indices"], blocks[1]["counts"], strict=True)) == want


def test_crc_of_slices():
    data = np.frombuffer(bytes(range(256)) * 3, np.uint8)
    starts, ends = np.array([0, 5, 9, 100, 700]), np.array([0, 6, 73, 600, 768])
    assert importance.crc32_slices(data, starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]


def spans_of(text):
    text, out = text or "", []
    for k, p in enumerate(secret_scan.PATTERNS):
        out += [(m.start(), k, m.end()) for m in re.finditer(p.pattern, text) if len(m[p.group]) >= p.least]
    for k, c in enumerate(secret_scan.CLASSES):
        for m in re.finditer(c.pattern, text):
            before = text[: m.start()]
            last = max((x.end() for x in re.finditer(c.pattern, before)), default=0)
            if any(re.search(p, before[max(last, len(before) - secret_scan.BEFORE) :] + m[0]) for p in secret_scan.ALLOW):
                continue
            covered = set()
            for i in range(m.start(), m.end() - c.window + 1):
                counts = Counter(text[i : i + c.window]).values()
                if sum(round(1e6 * n * math.log2(n)) for n in counts) <= c.limit:
                    covered |= set(range(i, i + c.window))
            edges = sorted(x for x in covered if x - 1 not in covered), sorted(x + 1 for x in covered if x + 1 not in covered)
            out += [(a, k + len(secret_scan.PATTERNS), b) for a, b in zip(*edges, strict=True)]
    return tuple(sorted(out))


def test_secrets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(secret_scan, "PIECE", 7)
    rnd = random.Random(3)
    draw = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    base64, hexa = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", "0123456789abcdef"
    texts = [None, "", "no secret", "x" * 5000, "token: password: abcdefghijklmn", "PassWord = 'abc.def-ghi_jkl'", "api_key=short secret:\t'x'", "é😀 APIKEY: \"0123456789abcdef0\"", "AKIAAKIA" + "A" * 14, "AKIA" + "Z" * 13, "ſecret=abcdefghijklmnop toKen=abcdefghijklmnop", f"sha256-{draw(base64, 44)}", f"data:image/png;base64,{draw(base64, 300)}", f"key {draw(hexa, 64)} commit {draw(hexa, 40)}", "a" * 60 + draw(base64, 40) + "b" * 60 + draw(base64, 30), draw(base64, 24) + "=" + draw(base64, 24), "EXAMPLE" + draw(base64, 40), draw(hexa, 24) * 2]
    texts += [" ".join(rnd.choice([draw(base64, rnd.randrange(70)), draw(hexa, rnd.randrange(50)), draw("abc", 40), "password=", "secret : ", "AKIA", "é", "token"]) for _ in range(60)) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (5, texts[7]), (None, texts[7])]
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, row int, spans string").repartition(3)
    got = Counter((r.doc_id, tuple(map(tuple, r.spans))) for r in secret_scan.scan_secrets(docs).collect())
    assert got == Counter((i, spans_of(t)) for i, t in rows)
    assert sum(s[1] > 2 for r in got for s in r[1]) > 20
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


def test_a_long_candidate_is_one_span(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice("0123456789abcdef") for _ in range(30_000))
    (row,) = secret_scan.scan_secrets(spark.createDataFrame([(1, f"x {long} y")], "doc_id long, text string")).collect()
    assert [tuple(s) for s in row.spans] == list(spans_of(f"x {long} y"))


def mined(rows, positives, negatives, low, high):
    good = [(i, v, y, [math.floor(256 * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for k, (i, _, y, q) in enumerate(good):
        if i % 5:
            continue
        others = [(-sum(a * b for a, b in zip(q, r, strict=True)), j, z, n) for n, (j, _, z, r) in enumerate(good) if n != k and len(r) == len(q)]
        for s, j, _, _ in sorted(o for o in others if o[2] == y)[:positives]:
            found = sorted(o for o in others if o[2] != y and -low * s <= -100 * o[0] <= -high * s)[:negatives]
            out.update((i, j, rank + 1, o[1], -s, -o[0]) for rank, o in enumerate(found))
    return out


@pytest.mark.parametrize(("digit", "cells"), [(10, 1 << 17), (2, 24)])
def test_hard_negatives_equal_brute_force(spark, digit, cells, monkeypatch):
    for name, value in (("DIGIT", digit), ("ROW_CELLS", cells), ("ANCHOR_CELLS", cells)):
        monkeypatch.setattr(hn, name, value)
    rnd = random.Random(digit)
    vector = lambda n: [rnd.choice([0.0, 0.25, rnd.uniform(-1, 1)]) for _ in range(n)]
    rows = [(i, vector(4), rnd.randrange(3)) for i in range(70)] + [(i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(100, 140)] + [(i, [0.45, 0.4, 0.4, 0.5], 7) for i in range(200, 215)]
    rows += [(300, None, 1), (305, [0.1, None, 0.2, 0.3], 1), (310, [0.1, math.nan, 0.2, 0.3], 1), (None, [0.5] * 4, 1), (315, [0.5] * 4, None), (320, [], 1), (321, [], 1), (322, [], 2), (325, [1e6, 2.0], 1), (326, [1e6, 2.0], 1), (327, [9e5, 2.0], 2), (5, [0.5] * 4, 0), (5, [0.5] * 4, 0), (330, [4e6, 1.0, 1.0], 4), (331, [4e6, 1.0, 0.0], 4), (332, [2.5e6, 7.0, 1.0], 5)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, row int, q string").repartition(3)
    run = lambda d: Counter(map(tuple, hn.hard_negatives(d, F.col("vec_id") % 5 == 0).collect()))
    want = mined(rows, 5, 3, 50, 95)
    assert len(want) > 300 and run(df) == want
    assert run(df.limit(0)) == Counter()
    assert run(df.where("vec_id = 320")) == Counter()


def test_blocks_of_counts_stay_small(spark):
    """Spark reads thousands of blocks at once, so a block ends with the document that passes 128 counts; borders hold across blocks."""
    random = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in random.integers(0, 900, n)) for n in random.integers(0, 300, 600)] + [None] * 600 + [" ".join(f"w{x}" for x in range(5000)), "w1 w1"]
    docs = [(None if i % 50 == 7 else i, t) for i, t in enumerate(texts)]
    blocks = importance.csr_blocks(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), 1, 10_000)
    rows = blocks.collect()
    assert all(r.indptr[-2] < 128 and len(r.doc_id) <= 256 for r in rows)
    assert [i for r in rows for i in r.doc_id] == [i for i, _ in docs] and all(r.indptr[0] == 0 and r.indptr[-1] == len(r.indices) == len(r.counts) and len(r.indptr) == len(r.doc_id) + 1 for r in rows)
    gain = random.integers(-9, 9, 10_000)
    want = Counter((i, len((t or "").split()), len((t or "").split()), sum(int(gain[zlib.crc32(w.encode()) % 10_000]) for w in (t or "").split())) for i, t in docs)
    assert Counter(map(tuple, importance.weights(blocks, gain).collect())) == want
