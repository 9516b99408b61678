"""Phenotype tables for QTL mapping: ratios, filters, imputation, scaling, rank normalisation, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intronaut.functions.products import column_products
from intronaut.functions.stats import qqnorm
from intronaut.operators.clustering import KEY

INTRON = ("clu", *KEY)
#: Chromosomes left out by default.
BLACKLIST = ("X", "Y")


def ratio(n: Column, tot: Column) -> Column:
    """(n + 0.5) / (tot + 0.5), null where the sample has no read of the cluster."""
    return F.when(tot >= 1, (n + 0.5) / (tot + 0.5))


def ratios(counts: DataFrame, blacklist: tuple[str, ...] = BLACKLIST) -> DataFrame:
    kept = counts.where(~F.col("chrom").isin(*blacklist)) if blacklist else counts
    return kept.select(*INTRON, "sample", ratio(F.col("n"), F.col("tot")).alias("ratio"))


def imputed(table: DataFrame, max_missing: float = 0.4, min_std: float = 0.005) -> DataFrame:
    """Rows with few missing ratios and enough spread, missing ones replaced by the intron's mean."""
    w = Window.partitionBy(*INTRON)
    counted = table.withColumn("missing", F.count("*").over(w) - F.count("ratio").over(w)).withColumn("samples", F.count("*").over(w))
    filled = counted.where(F.col("missing") <= max_missing * F.col("samples"))
    filled = filled.withColumn("value", F.coalesce("ratio", F.avg("ratio").over(w)))
    return filled.withColumn("std", F.stddev_pop("value").over(w)).where(F.col("std") >= min_std).select(*INTRON, "sample", "ratio", "value")


def scaled(table: DataFrame) -> DataFrame:
    """Row z-scores by the population deviation, as ``z``."""
    w = Window.partitionBy(*INTRON)
    return table.withColumn("z", (F.col("value") - F.avg("value").over(w)) / F.stddev_pop("value").over(w))


def normalised(table: DataFrame) -> DataFrame:
    """Per sample, the rank of each intron's z-score as a normal quantile, as ``q``."""
    return qqnorm(table.withColumn("zr", F.round("z", 9)), "zr", "q", "sample").drop("zr")


def summary(table: DataFrame) -> DataFrame:
    """Least, largest and mean ratio per intron, without imputed values. Ratios are added as decimals: the order of the rows doesn't change the last digit of a mean."""
    total, known = F.sum(F.col("ratio").cast("decimal(38,28)")), F.nullif(F.count("ratio"), F.lit(0).cast("long"))
    return table.groupBy(*INTRON).agg(F.min("ratio").alias("min_ratio"), F.max("ratio").alias("max_ratio"), (total / known.cast("decimal(9,0)")).cast("double").alias("mean_ratio"))


def components(table: DataFrame, value: str, samples: list[str], k: int) -> DataFrame:
    """Principal components over introns as rows: (pc, sample, loading, variance); signs are arbitrary."""
    import numpy as np

    k = min(k, len(samples))
    wide = table.groupBy(*INTRON).pivot("sample", samples).agg(F.first(value))
    rows = wide.select(F.array(*(F.col(f"`{s}`") for s in samples)).alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    n, sums, products = column_products(rows, "x", len(samples))
    covariance = (products - np.outer(sums, sums) / max(n, 1)) / max(n - 1, 1)
    values, vectors = (x[..., ::-1] for x in np.linalg.eigh(covariance))
    data = [(c + 1, s, float(vectors[i, c]), float(values[c])) for i, s in enumerate(samples) for c in range(k)]
    return table.sparkSession.createDataFrame(data, "pc int, sample string, loading double, variance double")
