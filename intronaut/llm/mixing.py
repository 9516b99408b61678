"""Mixing sources to target weights by systematic sampling.

Sources get shares of the total size by weight, capped at ``MOST`` times their own
size with the excess shared again. Within a source every document expects
``target / source size`` copies; along a fixed order the expected copies are
summed, one random offset is added, and a document is emitted once per integer
that its stretch of the sum crosses. Ordered by size, neighbours are alike, so
what a source gives misses its target by a share of its largest document, whether the
order goes up or down.

The order is global per source without putting a source into one task: rows are
range-partitioned and sorted, written once, and a row's rank is its place in its
partition plus the rows of its source in the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intronaut.scratch import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
#: Rows of small numbers (and a name of a source) that are broadcast.
BROADCAST_PIECES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): shares by weight with caps, in closed form.

    A capped source has a low cap per weight. In ascending order of cap / weight, a source
    is capped iff its cap is below its share of what the capped ones before it left.
    Rows are sources, not documents, so one sorted window over them is small.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weighted = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int")))
    ranked = weighted.withColumn("cap", F.col("source_size") * float(MOST))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = ranked.withColumn("level", left / F.sum("weight").over(after)).withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    level = level.withColumn("final", F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("weight")).alias("k"), F.col("source").alias("s"), F.col("level").alias("level")))).over(every)["level"])
    return level.select("source", "source_size", F.when(F.col("free") & F.col("final").isNotNull(), F.col("weight") * F.col("final")).otherwise(F.col("cap")).alias("target"))


def offset_of(source: Column) -> Column:
    """The offset of a source in [0, 1): the first 12 hexadecimal digits of a digest of its name."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(source, F.lit("\x00null"))).cast("binary")), 1, 12), 16, 10).cast("double") / float(16**12)


def mix_sources(docs: DataFrame) -> DataFrame:
    """Copies of each document that the mix takes.

    ``docs`` has doc_id, text and source. Returns one row per input row: doc_id, size, source,
    source_size, target, copies, taken (copies * size). Sources are ordered by code point,
    null last, and weigh 5, 2, 1, repeating. Null and empty texts have size 0 and
    are copied like any other; a source without words has target 0 and no copies. Copies never exceed
    ``MOST``. The result depends on the rows alone: repeated rows are told apart by place only.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"))
    # written, since dealing out by ranges looks at its input twice and counting words is the dear part
    return _with_copies(materialize(sized, "sized")).select("d.doc_id", "d.size", "d.source", "source_size", "target", "copies", (F.col("copies") * F.col("d.size")).alias("taken"))


def _with_copies(sized: DataFrame, *ties: str, wide: bool = False) -> DataFrame:
    """Rows of ``sized`` (doc_id, source, size and others) as ``d``, with source_size, target and their own copies.

    Rows equal in these three are ordered by ``ties``. To ``wide`` rows the pieces, a row per source and partition, are
    sent where they are at most ``BROADCAST_PIECES``; beyond, rows and pieces meet by a shuffle.
    """
    order = [F.asc_nulls_last("source"), F.asc("size"), F.asc_nulls_last("doc_id"), *(F.asc(c) for c in ties)]
    ordered = sized.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    pieces = placed.groupBy("source", part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"), F.sum("size").alias("words"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select("source", "part", "first", before.alias("before"))
    goal = targets(placed.groupBy("source").agg(F.sum("size").alias("source_size")))
    pieces = pieces.alias("p").join(goal.alias("g"), F.col("p.source").eqNullSafe(F.col("g.source"))).select("p.*", "source_size", "target", offset_of(F.col("p.source")).alias("offset"))
    if wide:
        pieces = materialize(pieces, "pieces")
        pieces = F.broadcast(pieces) if pieces.count() <= BROADCAST_PIECES else pieces
    ranked = placed.withColumn("part", part).alias("d").join(pieces.alias("p"), (F.col("d.part") == F.col("p.part")) & F.col("d.source").eqNullSafe(F.col("p.source")))
    rank = F.col("before") + F.col("at") - F.col("first")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("offset") + rate * (rank + 1)) - F.floor(F.col("offset") + rate * rank)
    copies = F.least(F.greatest(crossed, F.lit(0)), F.lit(MOST)).cast("long")
    return ranked.withColumn("copies", copies)


def emitted(docs: DataFrame, name: str = "copy") -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, once per copy, with the number of the copy from 1 as ``name``.

    Every row goes through the ranking whole and has the copies of its own place, also where ids repeat or are null.
    """
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(text).alias("size"), F.xxhash64(text).alias("tie"), F.struct(*docs.columns).alias("row"))
    found = _with_copies(sized, "tie", wide=True).where("copies > 0")
    return found.select("d.row.*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(name))
