"""Introns: pooling over samples, overlap islands, linked components, refinement.

Junctions are rows (chrom, strand, sample, a, b, n): ``a`` is the last base of the exon
before the intron, ``b`` the first base of the one after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intronaut.functions.ordering import numbered
from intronaut.operators.components import components
from intronaut.scratch import materialize

#: Chromosome names accepted by default, with or without prefix.
CHROMOSOMES = [p + c for p in ("", "chr") for c in (*map(str, range(1, 23)), "X", "Y")]
KEY = ("chrom", "strand", "a", "b")
#: Introns of an island that are folded in one row; larger islands are linked as a table.
FOLDED = 500


def known_chromosomes(junctions: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Rows on the accepted chromosomes."""
    return junctions.where(F.col("chrom").isin(names or CHROMOSOMES))


def pool_introns(junctions: DataFrame, max_length: int = 100_000, min_reads: int = 3) -> DataFrame:
    """Reads per intron over all samples; ambiguous strands and longer introns don't count.

    Rows with a null key don't count either, and a null ``n`` adds nothing.
    """
    usable = junctions.where(F.col("strand") != "?").dropna(subset=list(KEY)).where(F.col("b") - F.col("a") <= max_length)
    return usable.groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= min_reads)


def overlap_islands(introns: DataFrame) -> DataFrame:
    """Number the islands of overlapping closed intervals of each chromosome and strand from 1, as ``island``.

    Introns are range-partitioned in the order of their starts, so a chromosome may go over many tasks. What they have to know of
    the partitions before, how far their introns reach and how many islands they open, is one row per partition, chromosome and strand.
    """
    columns, order = introns.columns, ["chrom", "strand", "a", "b"]
    # written before, since a range exchange looks at its input twice
    rows = materialize(introns, "introns").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows.withColumn("_at", F.monotonically_increasing_id()), "ordered_introns").withColumn("_part", F.shiftright("_at", 33))
    keys = ["_part", "chrom", "strand"]
    own = Window.partitionBy(*keys).orderBy("_at")
    earlier = Window.partitionBy("chrom", "strand").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    reached = rows.groupBy(*keys).agg(F.max("b").alias("_last")).withColumn("_reach", F.max("_last").over(earlier)).drop("_last")
    reach = F.greatest("_reach", F.max("b").over(own.rowsBetween(Window.unboundedPreceding, -1)))
    met = rows.join(F.broadcast(reached), keys).withColumn("_open", (reach.isNull() | (F.col("a") > reach)).cast("int"))
    opened = met.groupBy(*keys).agg(F.sum("_open").alias("_all")).withColumn("_before", F.coalesce(F.sum("_all").over(earlier), F.lit(0))).drop("_all")
    island = F.col("_before") + F.sum("_open").over(own.rowsBetween(Window.unboundedPreceding, 0))
    return met.join(F.broadcast(opened), keys).select(*columns, island.cast("long").alias("island"))


def large_islands(islands: DataFrame, min_introns: int = 2, min_reads: int = 30) -> DataFrame:
    """Islands of at least so many introns and reads."""
    whole = Window.partitionBy("chrom", "strand", "island")
    sized = islands.withColumn("introns", F.count("*").over(whole)).withColumn("reads", F.sum("n").over(whole))
    return sized.where((F.col("introns") >= min_introns) & (F.col("reads") >= min_reads)).drop("introns", "reads")


def _groups(members: Column) -> Column:
    """Members (a, b, n) of one island in order, folded into groups that share a splice site."""
    kind = "array<struct<sites:array<bigint>,members:array<struct<a:bigint,b:bigint,n:bigint>>>>"

    def add(groups: Column, x: Column) -> Column:
        sites = F.array(x["a"], x["b"])
        hit = F.filter(groups, lambda g: F.arrays_overlap(g["sites"], sites))
        rest = F.filter(groups, lambda g: ~F.arrays_overlap(g["sites"], sites))
        merged = F.struct(
            F.array_distinct(F.concat(F.flatten(F.transform(hit, lambda g: g["sites"])), sites)).alias("sites"),
            F.concat(F.flatten(F.transform(hit, lambda g: g["members"])), F.array(x)).alias("members"),
        )
        return F.concat(rest, F.array(merged))

    return F.aggregate(members, F.array().cast(kind), add)


def linked_components(islands: DataFrame, *within: str, folded: bool = False) -> DataFrame:
    """Components of introns that share a coordinate, inside each island (and ``within``); those of two or more stay.

    ``component`` numbers them in the island from 1 in the order of their first intron. ``folded`` says that no island has more than ``FOLDED`` introns.
    """
    keys = ["chrom", "strand", "island", *within]
    if folded:
        return _folded_components(islands, keys)
    sized = islands.withColumn("_introns", F.count("*").over(Window.partitionBy(*keys)))
    small = _folded_components(sized.where(F.col("_introns") <= FOLDED).drop("_introns"), keys)
    large = sized.where(F.col("_introns") > FOLDED).select(*keys, "a", "b", "n")
    if not large.limit(1).count():
        return small
    return small.union(_table_components(large, keys))


def _table_components(islands: DataFrame, keys: list[str]) -> DataFrame:
    """Components of large islands over links from each intron to the first one of either of its sites."""
    rows = materialize(islands.select(*keys, *(F.col(c).cast("long").alias(c) for c in "abn"), F.monotonically_increasing_id().alias("id")), "large_islands")
    sites = rows.select(*keys, "id", F.explode(F.array("a", "b")).alias("site"))
    firsts = materialize(sites.groupBy(*keys, "site").agg(F.min("id").alias("u")), "sites")
    links = sites.join(firsts, [*keys, "site"]).where("u <> id").select("u", F.col("id").alias("v"))
    placed = rows.join(components(links).withColumnRenamed("node", "id"), "id")
    # the order of the first introns of an island's components: one row each
    heads = placed.groupBy(*keys, "component").agg(F.min(F.struct("a", "b", "n")).alias("head"))
    ranked = heads.withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("head")).cast("long"))
    return placed.join(ranked.select("component", "number"), "component").select(*keys, F.col("number").alias("component"), "a", "b", "n")


def _folded_components(islands: DataFrame, keys: list[str]) -> DataFrame:
    member = F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("n").cast("long").alias("n"))
    folded = islands.groupBy(*keys).agg(F.array_sort(F.collect_list(member)).alias("members"))
    groups = F.transform(_groups(F.col("members")), lambda g: F.array_sort(g["members"]))
    ordered = F.array_sort(F.filter(groups, lambda g: F.size(g) > 1))
    numbered = folded.select(*keys, F.posexplode(ordered).alias("component", "introns"))
    return numbered.select(*keys, (F.col("component") + 1).cast("long").alias("component"), F.inline("introns"))


def refine(components: DataFrame, min_ratio: float = 0.001, min_reads: int = 30, folded: bool = False) -> DataFrame:
    """Drop introns with a small share of their component or few reads, link what is left again.

    One pass is the fixed point: shares only grow when introns go, so none fails a second time.
    """
    total = F.sum("n").over(Window.partitionBy("chrom", "strand", "island", "component"))
    kept = components.withColumn("total", total).where((F.col("n") / F.col("total") >= min_ratio) & (F.col("n") >= min_reads)).drop("total")
    again = linked_components(kept.withColumnRenamed("component", "parent"), "parent", folded=folded)
    return again.withColumnRenamed("component", "part")


def number_clusters(refined: DataFrame) -> DataFrame:
    """Cluster numbers from 1 by (chrom, strand, island, parent, part), as ``clu``."""
    keys = ["chrom", "strand", "island", "parent", "part"]
    refined = materialize(refined, "refined")
    return refined.join(numbered(refined.select(*keys).distinct(), "clu", *keys), keys).select("clu", *KEY, "n")


def cluster_introns(junctions: DataFrame, max_length: int = 100_000, min_cluster_reads: int = 30, min_ratio: float = 0.001, min_reads: int | None = None) -> DataFrame:
    """Junctions -> (clu, chrom, strand, a, b, n); ``min_reads`` per intron is the cluster's minimum unless given."""
    islands = materialize(large_islands(overlap_islands(pool_introns(junctions, max_length)), 2, min_cluster_reads), "islands")
    # asked once, of a written table: what is left of an island is no larger than the island
    folded = islands.groupBy("chrom", "strand", "island").count().where(F.col("count") > FOLDED).isEmpty()
    return number_clusters(refine(linked_components(islands, folded=folded), min_ratio, min_cluster_reads if min_reads is None else min_reads, folded))


def constitutive_introns(junctions: DataFrame, max_length: int = 100_000, min_reads: int = 30) -> DataFrame:
    """Islands of one intron with enough reads: introns without alternative."""
    islands = overlap_islands(pool_introns(junctions, max_length))
    alone = F.count("*").over(Window.partitionBy("chrom", "strand", "island")) == 1
    return islands.withColumn("alone", alone).where(F.col("alone") & (F.col("n") >= min_reads)).select(*KEY, "n")


def intron_id(clu: str = "clu") -> Column:
    """``chrom:a:b:clu_<N>_<strand>``."""
    return F.concat_ws(":", "chrom", F.col("a").cast("string"), F.col("b").cast("string"), F.concat(F.lit("clu_"), F.col(clu).cast("string"), F.lit("_"), F.col("strand")))
