"""Samples with unusual usage of a cluster, by beta-binomial tails under one Dirichlet-multinomial per cluster."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from intronaut.functions.gamma import lgamma
from intronaut.functions.rounds import Model, fitted
from intronaut.functions.special import total
from intronaut.functions.stats import cluster_p
from intronaut.operators.differential import SUCCESS, TIMEOUT
from intronaut.scratch import materialize

#: Parameters are the concentrations alone, without a prior.
SHARES = Model(covariates=0, shape=1.0, rate=0.0)
#: Sum of the parameters that a fit starts from.
START_TOTAL = 10.0
EPS = 2.0**-52
#: Terms of a Gaussian sum.
NODES = 16


def testable(counts: DataFrame, max_size: int = 10, min_coverage: int = 20) -> DataFrame:
    """Clusters of 2 to ``max_size`` introns with two samples of enough reads; others are left out."""
    size = counts.select("clu", "a", "b").distinct().groupBy("clu").agg(F.count("*").alias("size"))
    covered = counts.groupBy("clu", "sample").agg(F.sum("n").alias("t")).groupBy("clu").agg(F.count_if(F.col("t") >= min_coverage).alias("covered"))
    good = size.join(covered, "clu").where((F.col("size") > 1) & (F.col("size") <= max_size) & (F.col("covered") >= 2)).select("clu")
    return counts.join(good, "clu", "left_semi")


def cluster_counts(counts: DataFrame, max_size: int = 10, min_coverage: int = 20) -> DataFrame:
    """A row per testable cluster: clu, k, introns (a, b) and rows, the samples with their counts plus one, both ordered."""
    cells = testable(counts, max_size, min_coverage).groupBy("clu", "a", "b", "sample").agg((F.sum("n") + 1).cast("double").alias("n"))
    samples = cells.groupBy("clu", "sample").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("a", "b"), "n"))).alias("cells"))
    introns = cells.groupBy("clu").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("introns"))
    met = samples.join(introns, "clu").withColumn("y", F.expr("transform(introns, i -> coalesce(element_at(cells, i), 1D))"))
    return met.groupBy("clu").agg(F.first("introns").alias("introns"), F.sort_array(F.collect_list(F.struct("sample", "y"))).alias("rows")).selectExpr("clu", "size(introns) as k", "introns", "rows")


def share_parameters(clusters: DataFrame, rounds: int = 60) -> DataFrame:
    """(clu, alpha, loglik, status): parameters of one Dirichlet-multinomial for all samples of each cluster, by maximum likelihood.

    ``clusters`` are rows of :func:`cluster_counts`. The status is ``timeout`` where the likelihood still rose after ``rounds`` steps; parameters
    are held below e^20, which samples without any variation beyond chance would exceed.
    """
    total_y = "aggregate(rows, 0D, (s, r) -> s + get(r.y, j))"
    sums = f"transform(sequence(0, k - 1), j -> {total_y} / size(rows) + 0.5D)"
    begun = clusters.selectExpr("clu", "k", "transform(rows, r -> struct(cast(array() as array<double>) as x, r.y as y)) as obs", f"{sums} as mean")
    # a parameter is its concentration times the uniform share 1 / k
    start = f"transform(mean, m -> ln(m / {total('mean')} * {START_TOTAL!r}D * k))"
    found = fitted(begun.selectExpr("clu", "k", "obs", f"{start} as start"), SHARES, rounds)
    return found.selectExpr("clu", "transform(theta, c -> exp(c) / size(theta)) as alpha", "value as loglik", f"if(converged, '{SUCCESS}', '{TIMEOUT}') as status")


@lru_cache(maxsize=64)
def _nodes(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights that sum a function over 0 .. length - 1 exactly where it is a polynomial of up to twice as many terms; all places if they are few."""
    if length <= NODES:
        return np.arange(length, dtype=float), np.ones(length)
    i = np.arange(1, NODES)
    off = np.sqrt(i**2 * (float(length) ** 2 - i**2) / (4 * (4 * i**2 - 1.0)))
    places, vectors = np.linalg.eigh(np.diag(off, 1) + np.diag(off, -1))
    return places + (length - 1) / 2, length * vectors[0] ** 2


def _two_sided(n: np.ndarray, tot: np.ndarray, alpha: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """See :func:`tails`."""
    high = n * (alpha + rest) > alpha * tot
    # the lower tail is the upper one of the other reads
    first, al, be = np.where(high, n, tot - n), np.where(high, alpha, rest), np.where(high, rest, alpha)
    fixed = lgamma(tot + 1) - lgamma(tot + al + be) + lgamma(al + be) - lgamma(al) - lgamma(be)

    def pmf(c: np.ndarray, rows: np.ndarray) -> np.ndarray:
        t, a, b, f = (v[rows][:, None] for v in (tot, al, be, fixed))
        return np.exp(f - lgamma(c + 1) - lgamma(t - c + 1) + lgamma(c + a) + lgamma(t - c + b))

    own = pmf(first[:, None], np.arange(len(n)))[:, 0]
    outer, at = np.zeros(len(n)), first.copy()
    left = np.arange(len(n))
    while len(left):
        # stretches as long as they are far from the count, and from the end
        room = np.minimum(at[left] - first[left], (tot[left] - at[left] + 1) / 2)
        lengths = 2 ** np.floor(np.log2(np.maximum(room, NODES))).astype(int)
        for length in np.unique(lengths):
            rows = left[lengths == length]
            places, weights = _nodes(int(length))
            c = at[rows][:, None] + places
            inside = c <= tot[rows][:, None]
            outer[rows] += np.where(inside, pmf(np.minimum(c, tot[rows][:, None]), rows), 0) @ weights
            at[rows] += length
        left = left[at[left] <= tot[left]]
    outer = np.minimum(outer, 1)
    inner = np.clip(1 - outer + own, 0, 1)
    return np.minimum(1, 2 * np.minimum(np.clip(outer, EPS, 1 - EPS), np.clip(inner, EPS, 1 - EPS)))


def tails(cells: DataFrame) -> DataFrame:
    """``cells`` (n, tot: a count and the reads of its sample and cluster; alpha, rest: its parameter and the sum of the others) with ``p``, two-sided.

    The smaller tail is summed from the count outwards, the other one is what is left; both include the count and lie within
    [eps, 1 - eps]. Next to the count and to the end every term is summed, between them stretches of doubled length by Gaussian sums of 16
    terms each, so the work grows with the logarithm of the reads.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                n, tot, alpha, rest = (part.column(c).to_numpy(zero_copy_only=False) for c in ("n", "tot", "alpha", "rest"))
                with np.errstate(all="ignore"):
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_two_sided(n, tot, alpha, rest))], [*part.schema.names, "p"])

    return cells.mapInArrow(run, StructType([*cells.schema.fields, StructField("p", DoubleType())]))


def outlier_cells(clusters: DataFrame, parameters: DataFrame) -> DataFrame:
    """Two-sided p-value and effect of every intron and sample of ``clusters`` at given parameters (clu, alpha)."""
    met = clusters.join(parameters.select("clu", "alpha"), "clu").select("clu", "introns", "alpha", F.explode("rows").alias("r"))
    cells = met.selectExpr("clu", "r.sample as sample", f"{total('r.y')} as tot", f"{total('alpha')} as all_alpha", "explode(arrays_zip(introns, r.y, alpha)) as c")
    named = cells.selectExpr("clu", "c.introns.a as a", "c.introns.b as b", "sample", "c.y as n", "tot", "c.alpha as alpha", "all_alpha - c.alpha as rest")
    return tails(named).selectExpr("clu", "a", "b", "sample", "p", "n / tot - alpha / (alpha + rest) as effect", "n / tot as share", "alpha / (alpha + rest) as mean_share")


def outliers(counts: DataFrame, max_size: int = 10, min_coverage: int = 20, rounds: int = 60) -> DataFrame:
    """Two-sided p-value and effect (share minus expected share) of every intron and sample, on counts plus one."""
    clusters = materialize(cluster_counts(counts, max_size, min_coverage), "clusters")
    return outlier_cells(clusters, share_parameters(clusters, rounds))


def cluster_outliers(cells: DataFrame) -> DataFrame:
    """p-value of each cluster and sample from the smallest of its introns."""
    return cells.groupBy("clu", "sample").agg(cluster_p(F.min("p"), F.count("*")).alias("p"))
