"""Importance resampling towards a target distribution, over a sparse document-by-bucket count matrix.

Features of a text (runs of up to ``max_words`` words) fall into hash buckets. The matrix of
counts is written once as CSR blocks: a block is some documents' row borders, bucket numbers
and counts, so a row of the table is bounded whatever the length of a text. Blocks are small,
since Spark reads 4096 rows of them at once, whatever their size. Its column sums
are the corpus distribution; those of the target's blocks are the target's. The gains of the
buckets, as many numbers as there are buckets, go to every task, which multiplies its blocks
by them. The draw is by Gumbel noise from a hash of the document's number, so reruns agree;
places in the draw come from range partitions.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intronaut.functions.ordering import placed
from intronaut.llm.words import NOT_ALNUM, Words, split_words
from intronaut.scratch import materialize

BLOCKS = "doc_id array<long>, n_words array<long>, indptr array<int>, indices array<int>, counts array<int>"
#: A block ends after so many counts or documents, but holds one document at least.
BLOCK_COUNTS, BLOCK_DOCUMENTS = 128, 256
#: Blocks that a task multiplies at once.
BLOCKS_AT_ONCE = 512
#: Longer features are hashed one at a time.
LONG_BYTES = 64
_BITS = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _BITS = (_BITS >> np.uint32(1)) ^ (np.uint32(0xEDB88320) * (_BITS & np.uint32(1)))


def crc32_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each slice of a byte array, all slices a byte at a time."""
    sizes = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    live, at = np.flatnonzero(sizes <= LONG_BYTES), 0
    while len(live := live[sizes[live] > at]):
        state = out[live]
        out[live] = _BITS[(state ^ data[starts[live] + at]) & np.uint32(255)] ^ (state >> np.uint32(8))
        at += 1
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > LONG_BYTES):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def _features(words: Words, max_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of the chunk, bucket) of each run of 1 to ``max_words`` words of a chunk.

    A further piece of a long row repeats its last ``max_words - 1`` words, runs inside of which are known already.
    """
    rows = np.repeat(np.arange(len(words.counts)), words.counts)
    data, starts, ends = words.data, words.starts, words.ends
    if max_words > 1 and len(starts):  # words side by side, one space between them
        sizes = ends - starts
        to = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        joined = np.full(int(to[-1] + sizes[-1]), 0x20, np.uint8)
        spread = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        joined[np.repeat(to, sizes) + spread] = data[np.repeat(starts, sizes) + spread]
        data, starts, ends = joined, to, to + sizes
    found = []
    for n in range(1, max_words + 1):
        first = max_words - n if words.base else 0
        at = np.arange(first, max(first, len(rows) - n + 1))
        at = at[rows[at] == rows[at + n - 1]]
        found.append((rows[at], crc32_slices(data, starts[at], ends[at + n - 1]).astype(np.int64) % buckets))
    return np.concatenate([r for r, _ in found]), np.concatenate([b for _, b in found])


def _blocks(max_words: int, buckets: int):
    def blocks(ids: pa.Array, n_words: np.ndarray, rows: np.ndarray, found: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        borders = np.searchsorted(rows, np.arange(len(ids) + 1))
        # a block begins where the counts before a document pass a multiple of BLOCK_COUNTS
        begins = (np.diff(borders[:-1] // BLOCK_COUNTS, prepend=-1) > 0) | (np.arange(len(ids)) % BLOCK_DOCUMENTS == 0)
        cuts = np.append(np.flatnonzero(begins), len(ids))
        sizes, first = np.diff(cuts) + 1, np.arange(len(cuts))
        block = np.repeat(first[:-1], sizes)
        indptr = borders[np.arange(len(block)) - block] - borders[cuts[block]]
        cells = [(cuts, ids), (cuts, pa.array(n_words.astype(np.int64))), (cuts + first, pa.array(indptr.astype(np.int32)))]
        cells += [(borders[cuts], pa.array(v.astype(np.int32))) for v in (found, counts)]
        return pa.record_batch([pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), v) for at, v in cells], ["doc_id", "n_words", "indptr", "indices", "counts"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, long_row, long_words = batch.column("doc_id"), None, 0
            for words in split_words(batch.column("text"), lower=True, separators=NOT_ALNUM, overlap=max_words - 1):
                rows, found = _features(words, max_words, buckets)
                if words.more or words.base:  # a long row is summed over its pieces
                    if not words.base:
                        long_row, long_words = np.zeros(buckets, np.int64), 0
                    long_row += np.bincount(found, minlength=buckets)
                    long_words = words.base + len(words.starts)
                    if not words.more:
                        held = np.flatnonzero(long_row)
                        yield blocks(ids.slice(words.first, 1), np.array([long_words]), np.zeros(len(held), np.int64), held, long_row[held])
                    continue
                keys, counts = np.unique(rows * buckets + found, return_counts=True)
                yield blocks(ids.slice(words.first, words.last - words.first), words.counts, keys // buckets, keys % buckets, counts)

    return build


def csr_blocks(docs: DataFrame, max_words: int = 1, buckets: int = 10_000) -> DataFrame:
    """Counts of the features of ``docs`` (doc_id, text) as CSR blocks of whole documents, about ``BLOCK_COUNTS`` counts each."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_blocks(max_words, buckets), BLOCKS)


def _some_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, len(batch), BLOCKS_AT_ONCE):
            yield batch.slice(first, BLOCKS_AT_ONCE)


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: every task sends the sums of its blocks, the driver gets ``buckets`` numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in _some_blocks(batches):
            found, counts = (batch.column(c).flatten().to_numpy() for c in ("indices", "counts"))
            np.add.at(total, found, counts)
        held = np.flatnonzero(total)
        yield pa.record_batch([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    sums = blocks.select("indices", "counts").mapInArrow(add, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the target's smoothed share of each bucket to the corpus's."""
    every_s, every_t, n = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (every_s + n) / ((float(s) + 1) * (every_t + n)))) for s, t in zip(corpus, target, strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): each document's counts times the gains of their buckets."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _some_blocks(batches):
            ids, n_words, borders, found, counts = (batch.column(c).flatten() for c in ("doc_id", "n_words", "indptr", "indices", "counts"))
            sizes, held = (np.diff(batch.column(c).offsets.to_numpy()) for c in ("indptr", "indices"))
            at = borders.to_numpy() + np.repeat(np.cumsum(held) - held, sizes)
            inside = np.ones(len(at) - 1, bool)
            inside[np.cumsum(sizes)[:-1] - 1] = False  # from a block's last border to the first one of the next
            counts = counts.to_numpy().astype(np.int64)
            sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[at])[inside] for v in (counts, counts * gain[found.to_numpy()])]
            yield pa.record_batch([ids, n_words, *(pa.array(v.astype(np.int64)) for v in sums)], ["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(multiply, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, max_words: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Draw ``percent`` of the documents of at least ``least_words`` words without replacement, likelier the more they resemble ``target``.

    ``docs`` has doc_id and text, ``target`` text; other columns are not read. Words are runs of letters,
    digits and everything beyond ASCII, A-Z in lower case. Returns one row per input row: doc_id, n_words,
    n_features, weight, score, rank (1, 2, 3... of those drawn, else null). Null and empty texts have no
    features and weight 0. A null doc_id has no noise and hence no score: its features count in the corpus, its row
    isn't drawn nor counted among those to draw from. Repeated rows are drawn each by itself. Without documents or without a target
    the sums are 0 and the smoothing alone stands.
    """
    blocks = materialize(csr_blocks(docs, max_words, buckets), "csr_blocks")
    wanted = csr_blocks(target.select(F.lit(0).alias("doc_id"), "text"), max_words, buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(wanted, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = materialize(weights(blocks, gain).withColumn("score", (F.col("weight") + noise).cast("long")), "weights")
    fit = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    size = scored.where(fit).count() * percent // 100
    drawn = placed(scored.where(fit), F.desc("score"), "doc_id", F.desc("n_features"), "weight")
    ranked = drawn.select(*scored.columns, F.when(F.col("_number") <= size, F.col("_number")).alias("rank"))
    return ranked.union(scored.where(~fit).withColumn("rank", F.lit(None).cast("long")))
