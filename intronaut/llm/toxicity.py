"""Toxicity: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A document is the set of its hashed unigrams, bigrams and one-word skip-grams.
Follow-the-regularised-leader keeps per coordinate the sum of adjusted gradients
and of squared gradients; each coordinate has its own rate and stays exactly
zero until its evidence exceeds the L1 penalty. The few weights that are not
zero travel to the executors in the closure of the scoring function.

The model is fitted on the driver, on at most ``SAMPLE`` labelled documents, the
ones with the least hash of their id; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intronaut.llm.words import NOT_ALNUM, U, Words, mix, split_words

#: Bound of the labelled documents that the model is fitted on.
SAMPLE = 12_000
BITS = 20
EPOCHS = 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.1
#: Weight of a labelled 1 in the loss, against the rarity of the class.
POSITIVE = 4.0
#: Words before one that share a feature with it.
OVERLAP = 2


@dataclass
class Model:
    """Bias and the weights that are not zero, by hashed feature."""

    bias: float
    features: np.ndarray
    weights: np.ndarray


def hashed_features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every unigram, bigram and skip-gram of the chunk, repeats included."""
    row = np.repeat(np.arange(len(words.counts)), words.counts)
    c = words.codes
    rows, codes = [row], [mix(c ^ U(1))]
    for gap, factor in ((1, 3), (2, 5)):
        inside = row[gap:] == row[:-gap]
        rows.append(row[gap:][inside])
        codes.append(mix(c[:-gap] * U(factor) + c[gap:])[inside])
    return np.concatenate(rows), (np.concatenate(codes) >> U(64 - BITS)).astype(np.int64)


def feature_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct features of each text."""
    pieces: list[np.ndarray] = []
    for words in split_words(column, lower=True, separators=NOT_ALNUM, overlap=OVERLAP):
        row, feature = hashed_features(words)
        key = np.unique((row << BITS) | feature)
        if words.more or words.base:  # a long text: the union of its pieces
            pieces.append(key)
            if not words.more:
                yield np.unique(np.concatenate(pieces))
                pieces = []
            continue
        at = np.searchsorted(key >> BITS, np.arange(len(words.counts) + 1))
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield key[a:b] & ((1 << BITS) - 1)


def fit(documents: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Model:
    """FTRL-proximal over the documents in the given order; coordinate 0 of ``z`` and ``n`` is the bias, not penalised."""
    if not len(documents):
        return Model(-np.inf, np.zeros(0, np.int64), np.zeros(0))
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    order = np.random.default_rng(7).permutation(len(documents))
    penalty = lambda at: np.where(at == 0, 0.0, L1)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return -(np.sign(zi) * np.maximum(np.abs(zi) - penalty(at), 0.0)) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for i in order:
            at = np.concatenate([[0], documents[i] + 1])
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            g *= POSITIVE if labels[i] else 1.0
            before = n[at]
            after = before + g * g
            z[at] += g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * w
            n[at] = after
    w = weights(np.arange(len(z)))
    used = np.flatnonzero(w[1:])
    return Model(float(w[0]), used, w[1:][used])


def score_column(model: Model, column: pa.Array) -> np.ndarray:
    """Probability of label 1 for whole texts; an empty text has the bias alone."""
    dense = np.zeros(1 << BITS)
    dense[model.features] = model.weights
    out, pieces = [], []
    for words in split_words(column, lower=True, separators=NOT_ALNUM, overlap=OVERLAP):
        row, feature = hashed_features(words)
        hit = dense[feature] != 0
        key = np.unique((row[hit] << BITS) | feature[hit])
        if words.more or words.base:  # a long text: its features are known with its last piece
            pieces.append(key)
            if words.more:
                continue
            key, pieces = np.unique(np.concatenate(pieces)), []
        total = np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)], minlength=len(words.counts)) + model.bias
        out.append(np.where(np.isinf(total), 0.0, 1.0 / (1.0 + np.exp(-np.clip(total, -700, 700)))))
    return np.concatenate(out) if out else np.zeros(0)


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> Model:
    """Fit on the labelled documents outside fold 0 of the id's crc32.

    Labels without id or value are not used; of conflicting labels of an id the larger
    counts, and of repeated documents one text. No usable label gives a model that scores 0.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(remainder(F.col("doc_id"), folds) != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    # of those that have a document; the bound is on rows, so this side of the join is small at any size
    known = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    found = rows.mapInArrow(_extract, "doc_id long, toxic int, features binary").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("features").alias("features")).toArrow().sort_by("doc_id")
    documents = [np.frombuffer(x.as_buffer(), np.int32) for x in found.column("features")]  # views, not copies
    return fit(documents, found.column("toxic").to_numpy())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        features = [x.astype(np.int32).tobytes() for x in feature_sets(batch.column("text"))]
        yield pa.record_batch([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()), pa.array(features, pa.binary())], ["doc_id", "toxic", "features"])


def score_with(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score (0 to 1) of the whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([*batch.columns, pa.array(score_column(model, batch.column("text")))], [*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def toxic_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per document; a null id is not held out."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score_with(texts, train(docs, labels, folds))
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
