"""Near-duplicate documents: MinHash bands propose, odd sketches sift, full sets decide.

Every document is one set of word shingles. ``SAMPLES`` MinHash values are cut
into bands of ``ROWS`` values; documents that share a band are candidates. The
same samples folded into a parity bitmap (odd sketch) give, by the population
count of the XOR of two bitmaps, a similarity estimate that is sharp near 1, and
only pairs that could reach the threshold are compared on full shingle sets.

Equal sets are collapsed first, so copies cost one row. Within a bucket each
document is compared with the bucket's centre. Where these stars leave several
components, the rows outside the largest one are compared with all others of the
bucket by a finer sketch, in blocks of rows that meet in memory; only pairs that
the sketch can't tell from linked ones leave a block. No bucket is capped, and none
has to fit in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intronaut.operators.components import components
from intronaut.llm.words import U, mix, shingle_sets, signed
from intronaut.scratch import materialize

BANDS, ROWS = 25, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
#: Standard deviations of the estimate by which a pair at the threshold may fall short of it.
SLACK = 4.0
#: Of the sketch for pairs within a bucket, and the rows of a bucket that meet at once (the root of its size, if that is more).
FINE_SAMPLES, FINE_BITS, BLOCK = 1024, 4096, 128
SIGNATURE = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, sketch array<long>"


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    place = np.arange(1, n + 1, dtype=U)
    return mix(place * U(0x9E3779B97F4A7C15)) | U(1), mix(place + U(100_000))


def minhash(codes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One MinHash value per factor of a non-empty set of fingerprints."""
    least = np.full(len(factors), U(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(codes), 256):
        block = codes[i : i + 256, None] * factors
        np.minimum(least, block.min(axis=0), out=least)
    return least


def odd_sketch(samples: np.ndarray, salts: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of the samples as 64-bit words: a sample flips the bit that its value and place hash to."""
    flips = np.bincount((mix(samples ^ salts) % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def odd_bits_limit(threshold: float, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> int:
    """Largest population count of a XOR that a pair at the threshold shows, ``SLACK`` deviations included.

    Of k samples k(1-J) differ in expectation; each differing sample flips two bits of n.
    """
    least = max(0.0, threshold - SLACK * math.sqrt(threshold * (1 - threshold) / samples))
    flips = 2 * samples * (1 - least)
    mean = bits / 2 * (1 - (1 - 2 / bits) ** flips)
    return math.ceil(mean + math.sqrt(mean))


def _slices(batch: pa.RecordBatch, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(batch), rows):
        yield batch.slice(i, rows)


def _signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, salts = _factors(SAMPLES)
        for batch in batches:
            for part in _slices(batch):
                sizes, a, b, bands, sketches, counts = [], [], [], [], [], []
                for codes in shingle_sets(part.column("text"), width):
                    sizes.append(len(codes))
                    a.append(int(np.bitwise_xor.reduce(codes, initial=U(0)).view(np.int64)))
                    b.append(int(mix(codes).sum(dtype=U).view(np.int64)))
                    counts.append(len(codes) > 0)
                    if len(codes):
                        samples = minhash(codes, factors)
                        rows = samples.reshape(BANDS, ROWS)
                        key = np.arange(1, BANDS + 1, dtype=U)
                        for r in range(ROWS):
                            key = mix(key ^ rows[:, r])
                        bands.append(signed(key))
                        sketches.append(odd_sketch(samples, salts, SKETCH_BITS))
                has = np.array(counts, np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(has * n)]).astype(np.int32)), pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))) for x, n in ((bands, BANDS), (sketches, SKETCH_BITS // 64))]
                yield pa.record_batch([part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), *lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    return sign


def _fine_signer(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, salts = _factors(FINE_SAMPLES)
        for batch in batches:
            sizes, sketches = [], []
            for codes in shingle_sets(batch.column("text"), width):
                sizes.append(len(codes))
                sketches.append(odd_sketch(minhash(codes, factors), salts, FINE_BITS).tobytes() if len(codes) else b"")
            yield pa.record_batch([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], ["rep", "n_shingles", "fine"])

    return sign


def _block_pairs(rows: dict[str, np.ndarray], percent: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an outsider (side 0) and another row (side 1) of one block pair, of different components, that size and sketch allow and that no earlier band has."""
    us, vs = [], []
    right = np.flatnonzero(rows["side"] == 1)
    for i in np.flatnonzero(rows["side"] == 0):
        # two outsiders meet in both orders
        j = right[(rows["component"][right] != rows["component"][i]) & ~(rows["outside"][right] & (rows["rep"][right] < rows["rep"][i]))]
        n, m = rows["n_shingles"][j], rows["n_shingles"][i]
        j = j[100 * np.minimum(n, m) >= percent * np.maximum(n, m)]
        if len(j):
            j = j[np.bitwise_count(rows["fine"][j] ^ rows["fine"][i]).sum(axis=1) <= limit]
        if len(j):
            shared = rows["bands"][j] == rows["bands"][i]
            first = rows["bands"][j, shared.argmax(axis=1)]
            j = j[first == rows["bucket"][i]]
        us.append(np.full(len(j), rows["rep"][i]))
        vs.append(rows["rep"][j])
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    return np.minimum(u, v), np.maximum(u, v)


def _block_sifter(percent: int):
    limit = odd_bits_limit(percent / 100, FINE_SAMPLES, FINE_BITS)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            rows = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "low", "high", "side", "outside", "rep", "component", "n_shingles")}
            rows["fine"] = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint64).reshape(len(table), -1)
            rows["bands"] = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
            new = np.flatnonzero(np.concatenate([[True], (np.diff(rows["bucket"]) != 0) | (np.diff(rows["low"]) != 0) | (np.diff(rows["high"]) != 0)]))
            for a, b in zip(new, [*new[1:], len(table)], strict=True):
                u, v = _block_pairs({k: x[a:b] for k, x in rows.items()}, percent, limit)
                if len(u):
                    yield pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

        key = lambda batch, i: tuple(batch.column(c)[i].as_py() for c in ("bucket", "low", "high"))
        for batch in batches:
            if not len(batch):
                continue
            # rows of one block pair may go on in the next batch: cut where the last one began
            cut, last = len(batch) - 1, key(batch, len(batch) - 1)
            while cut > 0 and key(batch, cut - 1) == last:
                cut -= 1
            if cut == 0 and held and key(held[-1], len(held[-1]) - 1) == last:
                held.append(batch)
                continue
            if cut:
                held.append(batch.slice(0, cut))
            if held:
                yield from flush()
            held.append(batch.slice(cut))
        if held:
            yield from flush()

    return sift


def _verifier(width: int, percent: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            sides = [shingle_sets(batch.column(c), width) for c in ("text_u", "text_v")]
            for i, (x, y) in enumerate(zip(*sides, strict=True)):
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if shared and 100 * shared >= percent * (len(both) - shared):
                    kept.append(i)
            yield pa.record_batch([batch.column("u").take(pa.array(kept, pa.int64())), batch.column("v").take(pa.array(kept, pa.int64()))], ["u", "v"])

    return verify


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """Classes of documents linked by Jaccard >= ``percent``/100 on distinct ``width``-word shingles.

    ``docs`` has doc_id and text; other columns are not read. Words are
    ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Returns one row per input row: doc_id,
    n_shingles, component_id (smallest doc_id reachable), kept. Null and empty texts have
    no shingle and link with nothing; fewer words than ``width`` make one shingle. Rows
    that repeat a doc_id are one node, linked by any of their texts. A null doc_id joins
    nothing: its component is the one of equal texts, if any, and it is never kept.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed_docs = materialize(docs.mapInArrow(_signer(width), SIGNATURE), "signatures")
    full = signed_docs.where("n_shingles > 0 and doc_id is not null")
    # written, so that the joins with it are between two exchanges and Spark may split the rows of a large class
    classes = materialize(full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "classes")
    reps = materialize(
        full.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "set_a", "set_b"]).groupBy("doc_id", "set_a", "set_b").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")).withColumnRenamed("doc_id", "rep"),
        "representatives",
    )
    buckets = reps.select("rep", F.explode("bands").alias("bucket"))
    # the centre of a bucket is the member whose id XOR the bucket's hash is least: another one in each bucket
    centres = buckets.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.col("rep").bitwiseXOR(F.col("bucket"))).alias("code")).where("n > 1").select("bucket", "n", F.col("code").bitwiseXOR(F.col("bucket")).alias("centre"))
    members = materialize(buckets.join(centres, "bucket"), "buckets")
    stars = members.where("rep <> centre").select(F.least("rep", "centre").alias("u"), F.greatest("rep", "centre").alias("v")).distinct()

    limit = odd_bits_limit(percent / 100)
    sketches = reps.groupBy("rep").agg(F.collect_list("sketch").alias("sketches"))
    differing = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n)

    def sifted(pairs: DataFrame, name: str) -> DataFrame:
        u, v = (sketches.select(F.col("rep").alias(c), F.col("sketches").alias(f"sketch_{c}")) for c in "uv")
        close = F.exists("sketch_u", lambda x: F.exists("sketch_v", lambda y: differing(x, y) <= limit))
        return materialize(pairs.join(u, "u").join(v, "v").where(close).select("u", "v"), name)

    # texts of the documents that have a bucket in common with any other, moved once
    texts = materialize(docs.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").select("doc_id", "text"), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        u, v = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"text_{c}")) for c in "uv")
        return pairs.join(u, "u").join(v, "v").select("u", "v", "text_u", "text_v").mapInArrow(_verifier(width, percent), "u long, v long")

    first = materialize(verified(sifted(stars, "stars")), "links")
    # rows of one doc_id with different texts are one node: classes that share a member
    joined = full.join(classes, ["set_a", "set_b"]).where("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    linked = materialize(components(first), "components")

    placed = members.select("bucket", "rep").join(linked.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    # buckets in several components, with the largest of these (hub) and how many rows are outside it; a pair that is all of its bucket has been compared
    sizes = placed.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    hubs = sizes.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("hub"), F.sum("k").alias("n"), F.count("*").alias("parts")).where("parts > 1 and n > 2")
    hubs = materialize(hubs.select("bucket", F.col("hub.component").alias("hub"), "n", (F.col("n") - F.col("hub.k")).alias("n_outside")), "hubs")
    rest = materialize(placed.join(hubs, "bucket").withColumn("outside", F.col("component") != F.col("hub")), "open_buckets")
    fine = texts.join(rest.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_fine_signer(width), "rep long, n_shingles long, fine binary")
    fine = materialize(fine.join(reps.select("rep", "bands"), "rep"), "fine_sketches")
    size = F.greatest(F.lit(float(BLOCK)), F.sqrt("n"))
    blocks, outer = (F.ceil(F.col(c) / size).cast("int") for c in ("n", "n_outside"))
    block = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    kept = ("rep", "component", "outside")
    left = rest.where("outside").select("bucket", block(outer).alias("low"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("high"), F.lit(0).alias("side"), *kept)
    right = rest.select("bucket", F.explode(F.sequence(F.lit(0), outer - 1)).alias("low"), block(blocks).alias("high"), F.lit(1).alias("side"), *kept)
    key = ("bucket", "low", "high")
    met = left.union(right).join(fine, "rep").select(*key, "side", *kept, "n_shingles", "fine", "bands")
    across = met.repartition(*key).sortWithinPartitions(*key).mapInArrow(_block_sifter(percent), "u long, v long")
    second = materialize(verified(materialize(across.distinct(), "across")), "more_links")
    repeated = full.groupBy("doc_id").agg(F.min("set_a").alias("a"), F.max("set_a").alias("b")).where("a <> b").select("doc_id")
    same_id = joined.join(repeated.withColumnRenamed("doc_id", "u"), "u", "left_semi")
    final = materialize(components(linked.select(F.col("node").alias("u"), F.col("component").alias("v")).union(second).union(same_id)), "components")
    by_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    out = signed_docs.select("doc_id", "n_shingles", "set_a", "set_b").join(by_class, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
