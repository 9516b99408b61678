"""Scores of given models and the fit of the linear one, recomputed word by word and byte by byte in plain Python."""

import math
import random
import re

import numpy as np
import pyarrow as pa

from intronaut.llm import language_id, toxicity
from intronaut.llm.words import NOT_ALNUM, U, mix, split_words

MASK = (1 << 64) - 1


def code(word):
    (words,) = split_words(pa.array([word]), separators=NOT_ALNUM)
    return int(words.codes[0])


def mixed(x):
    return int(mix(np.array([x & MASK], U))[0]) >> (64 - toxicity.BITS)


def features(text):
    c = [code(w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    found = {mixed(x ^ 1) for x in c}
    found |= {mixed(a * 3 + b) for a, b in zip(c, c[1:], strict=False)}
    return found | {mixed(a * 5 + b) for a, b in zip(c, c[2:], strict=False)}


def test_toxicity_scores_equal_brute_force(spark):
    rnd = random.Random(4)
    texts = [None, "", "one", "One two", "a b a b a", "?!", "É é e"] + [" ".join(rnd.choice(["ab", "Cd", "e-f", "gh1", "é"]) for _ in range(rnd.randrange(40))) for _ in range(20)]
    used = sorted({f for t in texts[::2] for f in features(t)})
    model = toxicity.Model(-0.7, np.array(used), np.array([rnd.uniform(-1, 1) or 0.5 for _ in used]))
    weight = dict(zip(used, model.weights.tolist(), strict=True))
    got = toxicity.score_with(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3), model).collect()
    for r in got:
        assert abs(r.score - 1 / (1 + math.exp(0.7 - sum(weight.get(f, 0.0) for f in features(r.text))))) < 1e-12


def test_ftrl_equals_brute_force():
    """Per-coordinate rates and the soft threshold, one document and one coordinate at a time."""
    rnd = random.Random(6)
    documents = [np.array(sorted(rnd.sample(range(50), rnd.randrange(12))), np.int64) for _ in range(60)]
    labels = np.array([rnd.random() < 0.3 for _ in documents]).astype(int)
    z, n = {}, {}

    def weight(j):
        penalty = 0.0 if j < 0 else toxicity.L1
        zj = z.get(j, 0.0)
        return 0.0 if abs(zj) <= penalty else -(zj - math.copysign(penalty, zj)) / ((toxicity.BETA + math.sqrt(n.get(j, 0.0))) / toxicity.ALPHA + toxicity.L2)

    for _ in range(30):
        for i in np.random.default_rng(7).permutation(len(documents)):
            at = [-1, *documents[i].tolist()]
            w = {j: weight(j) for j in at}
            g = (1 / (1 + math.exp(-sum(w.values()))) - labels[i]) * (toxicity.POSITIVE if labels[i] else 1.0)
            for j in at:
                sigma = (math.sqrt(n.get(j, 0.0) + g * g) - math.sqrt(n.get(j, 0.0))) / toxicity.ALPHA
                z[j], n[j] = z.get(j, 0.0) + g - sigma * w[j], n.get(j, 0.0) + g * g
    model = toxicity.fit(documents, labels, 30)
    want = {j: weight(j) for j in range(50) if weight(j)}
    assert abs(model.bias - weight(-1)) < 1e-9 and set(model.features.tolist()) == set(want) and want
    assert all(abs(w - want[j]) < 1e-9 for j, w in zip(model.features.tolist(), model.weights.tolist(), strict=True))


def test_language_probabilities_equal_a_loop():
    """The recurrence of both directions over the bytes of a text, one number at a time."""
    p = {k: v.astype(float) for k, v in language_id.initial(3, np.random.default_rng(2)).items()}
    n, sigmoid = language_id.HIDDEN, lambda x: 1 / (1 + math.exp(-x))
    texts = ["", "a", "Hello wörld, " * 9, "x" * language_id.STRETCH, None]

    def states(d, data):
        h, out = [0.0] * n, {}
        for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
            x = [p[f"x{d}"][data[t]][k] + p[f"c{d}"][k] for k in range(3 * n)]
            a = [sum(h[m] * p[f"u{d}"][m][k] for m in range(n)) for k in range(3 * n)]
            z, r = [sigmoid(x[k] + a[k]) for k in range(n)], [sigmoid(x[n + k] + a[n + k]) for k in range(n)]
            c = [math.tanh(x[2 * n + k] + r[k] * a[2 * n + k]) for k in range(n)]
            h = [c[k] + z[k] * (h[k] - c[k]) for k in range(n)]
            out[t] = h
        return out

    got = language_id.probabilities({k: v.astype(np.float32) for k, v in p.items()}, pa.array(texts))
    for row, text in zip(got, texts, strict=True):
        data, total = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()), np.zeros(3)
        for first in range(0, len(data), language_id.STRETCH):
            piece = data[first : first + language_id.STRETCH]
            padded = piece + bytes(language_id.STRETCH - len(piece))
            forward, backward = states("f", padded), states("b", padded)
            for t in range(len(piece)):
                e = [math.exp(sum(forward[t][m] * p["o"][m][c] for m in range(n)) + sum(backward[t][m] * p["o"][n + m][c] for m in range(n)) + p["q"][c]) for c in range(3)]
                total += np.array(e) / sum(e)
        assert np.abs(row - total / max(1, len(data))).max() < 1e-4
