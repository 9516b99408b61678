"""Near-duplicate embeddings by collision counting over sorted projections.

A line of work is: project every unit vector on one random direction, sort, and
let each vector collide with those within ``WINDOW`` of it. One direction alone
makes a fixed share of all pairs collide, however many rows there are; so each of
the ``groups`` sorts is by the signs of ``bits`` further projections first and by
the windowed projection last. ``bits`` grows with the logarithm of the largest
label, which keeps the rows that share a sign code few. Collisions are counted per
pair over the groups, and pairs with at least ``COUNT`` are compared in double
precision. The number of groups is calibrated: the binomial tail that a pair at
the threshold collides often enough is at least ``RECALL``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intronaut.operators.components import components
from intronaut.llm.words import U, mix, signed
from intronaut.scratch import materialize

COUNT = 2
RECALL = 0.9995
#: Rows of a label that share a sign code on average.
CELL = 48
#: Half width of the window in units of the distance at the threshold.
WIDTH = 2.0
SEED = 20_177


def calibrate(largest: int, threshold: float) -> tuple[int, int, float]:
    """(sign bits, groups, half width) for a label of ``largest`` distinct vectors."""
    bits = min(40, max(0, math.ceil(math.log2(max(1, largest) / CELL))))
    distance = math.sqrt(2 - 2 * threshold)
    hit = (1 - math.acos(threshold) / math.pi) ** bits * math.erf(WIDTH / math.sqrt(2))
    groups = COUNT
    while sum(math.comb(groups, i) * hit**i * (1 - hit) ** (groups - i) for i in range(COUNT)) > 1 - RECALL:
        groups += 1
    return bits, groups, WIDTH * distance


def _dense(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) for each length of vector in the batch."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    lengths = np.array([len(x) for x in column], np.int64)
    ends = np.cumsum(lengths)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        x = flat[(ends[rows] - n)[:, None] + np.arange(n)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        yield rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _projector(bits: int, groups: int, width: float):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = (batch.column(c).to_numpy() for c in ("key", "label"))
            for rows, x in _dense(batch.column("embedding")):
                rng = np.random.default_rng([SEED, x.shape[1]])
                for g in range(groups):
                    lines = rng.standard_normal((x.shape[1], bits + 1))
                    y = x @ lines
                    code = (y[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                    cell = mix(mix(code.astype(U) ^ (U(g) << U(48))) ^ mix(labels[rows].astype(np.int64).view(U)) ^ U(x.shape[1]))
                    yield pa.record_batch([pa.array(ids[rows]), pa.array(signed(cell)), pa.array(y[:, bits])], ["key", "cell", "place"])

    return project


def _cosine(threshold: float):
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.array(batch.column(c).flatten().to_numpy(zero_copy_only=False), float) for c in ("x", "y"))
            n = np.array([len(a) for a in batch.column("x")], np.int64)
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            if len(x):  # by the largest component, so that squares neither overflow nor vanish
                x, y = (a / np.repeat(np.maximum.reduceat(np.abs(a), at), n) for a in (x, y))
            dots = [np.add.reduceat(a, at) if len(a) else np.zeros(0) for a in (x * y, x * x, y * y)]
            keep = pa.array(dots[0] / (np.sqrt(dots[1]) * np.sqrt(dots[2])) >= threshold)
            yield pa.record_batch([batch.column(c).filter(keep) for c in "uv"], ["u", "v"])

    return close


def similar_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Links between vectors of one label with cosine >= ``threshold``, and their components.

    ``vectors`` has vec_id, embedding (array of numbers) and label. Vectors that are null,
    empty, zero or hold null, NaN or infinite components, and vectors of different lengths, link with
    nothing, neither does a null label. Returns one row per input row: vec_id, n_links
    (other rows linked directly), component_id, kept. Equal vectors of a label are one
    class: every pair of them is a link, counted but not made. Rows that repeat a vec_id
    are vectors of their own, linked with each other by their cosine alone; a null vec_id is in no component and its row gets the null back.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    valid = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = rows.where(valid)
    # a class has a key of its own, since classes may share a vec_id
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("key", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, groups, width = calibrate(largest, threshold)
    lines = materialize(classes.select("key", "label", "embedding").mapInArrow(_projector(bits, groups, width), "key long, cell long, place double"), "projections")
    strip = F.floor(F.col("place") / width)
    left = lines.select("cell", strip.alias("strip"), F.col("key").alias("a"), F.col("place").alias("pa"))
    right = lines.select("cell", F.explode(F.array(strip, strip - 1)).alias("strip"), F.col("key").alias("b"), F.col("place").alias("pb"))
    inside = ((F.col("pa") < F.col("pb")) | ((F.col("pa") == F.col("pb")) & (F.col("a") < F.col("b")))) & (F.col("pb") - F.col("pa") <= width)
    pairs = left.join(right.hint("merge"), ["cell", "strip"]).where(inside)
    counted = pairs.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).count().where(F.col("count") >= COUNT).select("u", "v")
    x, y = (classes.select(F.col("key").alias(k), F.col("label").alias(f"label_{k}"), F.col("embedding").alias(c)) for k, c in ("ux", "vy"))
    compared = counted.join(x, "u").join(y, "v").where("label_u = label_v and size(x) = size(y)").select("u", "v", "x", "y")
    links = materialize(compared.mapInArrow(_cosine(threshold), "u long, v long"), "links")
    sizes = classes.select("key", "n", "rep")
    both = links.union(links.select("v", "u"))
    outward = both.join(sizes.withColumnRenamed("key", "v"), "v").groupBy("u").agg(F.sum("n").alias("others"))
    node = components(links)
    least = node.join(sizes, F.col("node") == F.col("key")).groupBy("component").agg(F.min("rep").alias("least"))
    reached = node.join(least, "component").select(F.col("node").alias("key"), "least")
    met = classes.join(outward.withColumnRenamed("u", "key"), "key", "left").join(reached, "key", "left")
    per_class = met.select("label", "embedding", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    placed = good.join(per_class, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
