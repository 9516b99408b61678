"""Language identification by a bidirectional gated recurrent network over bytes.

A text is cut into stretches of ``STRETCH`` bytes. In each, one recurrent network reads
forward and one backward; both states at a byte give that byte's label
probabilities, and a document's probabilities are the mean over all its bytes.
The network is small, lives in numpy arrays and is trained by
backpropagation through time on the driver, on a bounded sample: at most
``DOCUMENTS`` documents of a language and ``STRETCHES`` stretches of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from intronaut.llm.toxicity import remainder
from intronaut.llm.words import LOWER, strings
from intronaut.scratch import materialize

STRETCH, HIDDEN = 64, 8
DOCUMENTS, STRETCHES = 400, 12
#: Largest number of languages whose counts are broadcast; more are joined by shuffle.
BROADCAST_LANGUAGES = 10_000
BATCH, EPOCHS, RATE = 256, 4, 0.02
#: Stretches computed at once when predicting: their states stay in the caches.
WIDE = 1024
UNKNOWN = "und"

Params = dict[str, np.ndarray]


def initial(classes: int, rng: np.random.Generator) -> Params:
    p: Params = {}
    for d in "fb":
        p[f"x{d}"] = rng.normal(0, 0.3, (256, 3 * HIDDEN))
        p[f"u{d}"] = rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
        p[f"c{d}"] = np.zeros(3 * HIDDEN)
    p["o"] = rng.normal(0, 0.3, (2 * HIDDEN, classes))
    p["q"] = np.zeros(classes)
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + np.float32(0.5)


def _states(p: Params, d: str, data: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction for stretches (rows of bytes), and what the way back needs."""
    table, u, n = p[f"x{d}"] + p[f"c{d}"], p[f"u{d}"], HIDDEN
    steps = range(data.shape[1]) if d == "f" else range(data.shape[1] - 1, -1, -1)
    h, out, trace = np.zeros((len(data), n), np.float32), np.empty((data.shape[1], len(data), n), np.float32), []
    for t in steps:
        x, a = table[data[:, t]], h @ u
        gates = _sigmoid(x[:, : 2 * n] + a[:, : 2 * n])
        z, r = gates[:, :n], gates[:, n:]
        c = np.tanh(x[:, 2 * n :] + r * a[:, 2 * n :])
        if keep:
            trace.append((t, h, z, r, c, a[:, 2 * n :]))
        h = c + z * (h - c)
        out[t] = h
    return out, trace


def _back(p: Params, d: str, data: np.ndarray, trace: list, dout: np.ndarray) -> Params:
    """Gradients of one direction by backpropagation through time."""
    n, u = HIDDEN, p[f"u{d}"]
    dx, du, dh = np.zeros_like(p[f"x{d}"]), np.zeros_like(u), np.zeros((len(data), n), np.float32)
    for t, h, z, r, c, a in reversed(trace):
        dh = dh + dout[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * a * r * (1 - r)
        into = np.concatenate([dz, dr, dc], axis=1)
        np.add.at(dx, data[:, t], into)
        recurrent = np.concatenate([dz, dr, dc * r], axis=1)
        du += h.T @ recurrent
        dh = dh * z + recurrent @ u.T
    return {f"x{d}": dx, f"u{d}": du, f"c{d}": dx.sum(axis=0)}


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def gradients(p: Params, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, Params]:
    """Mean cross-entropy over all positions within the lengths, and its gradients."""
    forward, tf = _states(p, "f", data, True)
    backward, tb = _states(p, "b", data, True)
    both = np.concatenate([forward, backward], axis=2)
    prob = _softmax(both @ p["o"] + p["q"])
    inside = (np.arange(data.shape[1])[:, None] < lengths[None, :]).astype(np.float32)
    rows = np.arange(len(data))
    loss = -(np.log(prob[:, rows, labels] + 1e-9) * inside).sum() / inside.sum()
    prob[:, rows, labels] -= 1
    dlogit = prob * (inside / inside.sum())[:, :, None]
    flat = dlogit.reshape(-1, dlogit.shape[2])
    dboth = dlogit @ p["o"].T
    g = {"o": both.reshape(-1, both.shape[2]).T @ flat, "q": flat.sum(axis=0)}
    g |= _back(p, "f", data, tf, dboth[:, :, :HIDDEN]) | _back(p, "b", data, tb, dboth[:, :, HIDDEN:])
    return float(loss), g


def fit(data: np.ndarray, lengths: np.ndarray, labels: np.ndarray, classes: int, epochs: int = EPOCHS) -> Params:
    """Adam over shuffled batches; the same rows in the same order give the same network."""
    rng = np.random.default_rng(5)
    p = initial(classes, rng)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    step, total = 0, max(1, epochs * -(-len(data) // BATCH))
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), BATCH):
            at = order[i : i + BATCH]
            _, g = gradients(p, data[at], lengths[at], labels[at])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            rate = RATE * (1 - (step - 1) / total) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k in p:
                x = g[k] * min(1.0, 1.0 / (norm + 1e-9))
                m[k] += 0.1 * (x - m[k])
                v[k] += 0.001 * (x * x - v[k])
                p[k] = (p[k] - rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype(np.float32)
    return p


def stretches(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, row of each stretch, its bytes padded with 0, its length) of whole texts, some thousand stretches at a time."""
    data, borders = strings(column)
    sizes = np.diff(borders)
    counts = -(-sizes // STRETCH)
    row = np.repeat(np.arange(len(sizes)), counts)
    first = np.repeat(np.cumsum(counts) - counts, counts)
    start = borders[row] + (np.arange(len(row)) - first) * STRETCH
    length = np.minimum(STRETCH, borders[row + 1] - start)
    for i in range(0, len(row), WIDE):
        s, n = start[i : i + WIDE], length[i : i + WIDE]
        at = np.minimum(s[:, None] + np.arange(STRETCH), len(data) - 1)
        yield len(sizes), row[i : i + WIDE], np.where(np.arange(STRETCH) < n[:, None], LOWER[data[at]], 0).astype(np.uint8), n


def probabilities(p: Params, column: pa.Array) -> np.ndarray:
    """Mean label probabilities over all bytes of each text; an empty text has zeros."""
    total, size = np.zeros((len(column), len(p["q"]))), np.zeros(len(column))
    for n, row, data, length in stretches(column):
        forward, backward = _states(p, "f", data, False)[0], _states(p, "b", data, False)[0]
        logits = forward.reshape(-1, HIDDEN) @ p["o"][:HIDDEN] + backward.reshape(-1, HIDDEN) @ p["o"][HIDDEN:] + p["q"]
        prob = _softmax(logits).reshape(STRETCH, len(data), -1)
        prob *= (np.arange(STRETCH)[:, None] < length[None, :])[:, :, None]
        sums = prob.sum(axis=0)
        for c in range(sums.shape[1]):
            total[:, c] += np.bincount(row, weights=sums[:, c], minlength=n)
        size += np.bincount(row, weights=length, minlength=n)
    return total / np.maximum(size, 1)[:, None]


def _pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        picked: list[tuple[int, bytes, int]] = []
        found: dict[int, list[tuple[bytes, int]]] = {}
        for _, row, data, length in stretches(batch.column("text")):
            for r, x, n in zip(row.tolist(), data, length.tolist(), strict=True):
                found.setdefault(r, []).append((x.tobytes(), n))
        for r, own in found.items():
            order = np.random.default_rng(abs(int(ids[r]))).permutation(len(own))[:STRETCHES]
            picked += [(r, *own[k]) for k in order]
        rows = [x[0] for x in picked]
        yield pa.record_batch([batch.column("doc_id").take(pa.array(rows, pa.int64())), batch.column("lang").take(pa.array(rows, pa.int64())), pa.array([x[1] for x in picked], pa.binary()), pa.array([x[2] for x in picked], pa.int32())], ["doc_id", "lang", "data", "length"])


def train(docs: DataFrame, folds: int = 3, held: int = 1, documents: int = DOCUMENTS) -> tuple[list[str], Params]:
    """Languages and network, from documents with id, text and lang outside fold ``held`` of the id's crc32.

    All languages are learned, each from ``documents`` different documents at most: the sample is what the driver holds.
    """
    known = docs.where("doc_id is not null and lang is not null and text <> ''").where(remainder(F.col("doc_id"), folds) != held)
    counts = materialize(known.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    # few rows need no dealing of the texts by language to meet them
    counts = F.broadcast(counts) if counts.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES else counts
    code = F.xxhash64("doc_id", "text", F.lit(23))
    drawn = known.withColumn("code", code).join(counts, "lang").where(F.pmod("code", F.lit(1 << 30)) / float(1 << 30) * F.col("n") < documents)
    # a repeated row is one document, and no language has more than it may
    once = drawn.groupBy("lang", "doc_id", "code").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("code", F.lit(1 << 30)), "doc_id"))
    chosen = once.withColumn("place", place).where(F.col("place") <= documents).select("doc_id", "lang", "text")
    found = chosen.mapInArrow(_pick, "doc_id long, lang string, data binary, length int").toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("data", "ascending")])
    names = sorted(set(found.column("lang").to_pylist()))
    if not names:
        return names, {}
    data = np.frombuffer(b"".join(found.column("data").to_pylist()), np.uint8).reshape(-1, STRETCH)
    labels = np.array([names.index(x) for x in found.column("lang").to_pylist()])
    return names, fit(data, found.column("length").to_numpy(), labels, len(names))


def identify(docs: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row by its whole text.

    ``docs`` has doc_id, text and lang; lang is read for training rows only. A text that is null or has no
    letter is ``und`` with score 0, and so is every text if no language could be learned. A null
    doc_id is not held out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    names, params = train(docs, folds, held)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if names:
                prob = probabilities(params, batch.column("text"))
                best = prob.argmax(axis=1)
                label, score = pa.array(names).take(pa.array(best)), prob[np.arange(len(best)), best]
            else:
                label, score = pa.array([UNKNOWN] * len(batch)), np.zeros(len(batch))
            yield pa.record_batch([batch.column("doc_id"), batch.column("has_letter"), label, pa.array(np.clip(score, 0.0, 1.0))], ["doc_id", "has_letter", "lang_pred", "score"])

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.select("doc_id", "text", has_letter.alias("has_letter")).mapInArrow(predict, "doc_id long, has_letter boolean, lang_pred string, score double")
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == held, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.when(F.col("has_letter"), F.col("lang_pred")).otherwise(UNKNOWN).alias("lang_pred"), F.when(F.col("has_letter"), F.col("score")).otherwise(0.0).alias("score"))
