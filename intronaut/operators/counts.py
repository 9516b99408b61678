"""Counts per sample and intron, their totals per cluster, library checks and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intronaut.operators.clustering import KEY, intron_id


def sample_counts(junctions: DataFrame) -> DataFrame:
    """Reads per sample and intron; repeated rows of a sample add up."""
    return junctions.groupBy("sample", *KEY).agg(F.sum("n").alias("n"))


def perind_counts(clusters: DataFrame, junctions: DataFrame) -> DataFrame:
    """Every sample's reads ``n`` of every clustered intron, 0 where it has none, and its ``tot`` in the cluster.

    The list of samples is a scalar, so the grid is made row by row without a join.
    """
    samples = junctions.select("sample").distinct()
    introns = clusters.select("clu", *KEY)
    counted = sample_counts(junctions.join(introns.select(*KEY).distinct(), list(KEY), "left_semi"))
    names = samples.agg(F.array_sort(F.collect_set("sample")).alias("names"))
    grid = introns.withColumn("sample", F.explode(names.scalar()))
    filled = grid.join(counted, ["sample", *KEY], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    total = F.sum("n").over(Window.partitionBy("clu", "sample"))
    return filled.withColumn("tot", total).select("clu", *KEY, "sample", "n", "tot")


def wide(counts: DataFrame, samples: list[str], cell: str = "numers") -> DataFrame:
    """A row per intron id and a column per sample: ``n`` (``numers``) or ``n/tot`` (``ratios``)."""
    value = F.first("n") if cell == "numers" else F.first(F.concat_ws("/", F.col("n").cast("string"), F.col("tot").cast("string")))
    return counts.withColumn("intron", intron_id()).groupBy("intron").pivot("sample", samples).agg(value)


def library_qc(junctions: DataFrame) -> DataFrame:
    """Rows and chromosomes per sample; ``flagged`` where it has fewer chromosomes than the best one."""
    per = junctions.groupBy("sample").agg(F.count("*").alias("n_rows"), F.countDistinct("chrom").alias("n_chroms"))
    return per.withColumn("flagged", F.col("n_chroms") < F.max("n_chroms").over(Window.partitionBy()))


def common_chroms(junctions: DataFrame) -> DataFrame:
    """Chromosomes that every sample has (relational division)."""
    pairs = junctions.select("sample", "chrom").distinct()
    total = pairs.agg(F.countDistinct("sample")).scalar()
    return pairs.groupBy("chrom").agg(F.count("*").alias("k")).where(F.col("k") == total).select("chrom")


def usage(n: Column, tot: Column) -> Column:
    """Share n / (1 + tot)."""
    return n / (tot + 1)


def usage_stats(counts: DataFrame) -> DataFrame:
    """Mean, median, least and largest usage per intron over the samples."""
    used = counts.withColumn("u", usage(F.col("n"), F.col("tot")))
    return used.groupBy("clu", *KEY).agg(F.avg("u").alias("mean_usage"), F.median("u").alias("median_usage"), F.min("u").alias("min_usage"), F.max("u").alias("max_usage"))


def psi(counts: DataFrame) -> DataFrame:
    """n / tot per intron and sample; null where the sample has no read of the cluster."""
    return counts.withColumn("psi", F.col("n") / F.nullif(F.col("tot"), F.lit(0).cast("long")))
