import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from intronaut.functions import models, rounds, stats
from intronaut.operators import differential, outlier
import brute_models


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.02), (3, None), (4, 0.04)], "i int, p double")
    got = [r.q for r in stats.adjusted_fdr(df, "p", "q").orderBy("i").collect()]
    assert got[2] is None and [round(x, 9) for x in got if x is not None] == [0.03, 0.03, 0.04]


def test_adjusted_p_values_equal_the_definition(spark):
    rng = np.random.default_rng(4)
    p = [None if rng.random() < 0.1 else round(float(rng.random()), 2) for _ in range(500)]
    df = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(p)], "i int, g int, p double").repartition(6)
    for by in ((), ("g",)):
        got = {r.i: r.q for r in stats.adjusted_fdr(df, "p", "q", *by).collect()}
        for part in ([range(500)] if not by else [range(k, 500, 3) for k in range(3)]):
            known = sorted((p[i], i) for i in part if p[i] is not None)
            least = 1.0
            for rank in range(len(known), 0, -1):
                value, i = known[rank - 1]
                least = min(least, value * len(known) / rank)
                assert got[i] == pytest.approx(min(v for v in [least] + [known[k][0] * len(known) / (k + 1) for k in range(rank - 1, len(known))]))
            assert all(got[i] is None for i in part if p[i] is None)


def test_normal_scores(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    assert [round(r.q, 4) for r in stats.qqnorm(df, "x", "q").orderBy("x").collect()] == [-0.8694, 0.0, 0.8694]


def test_closed_forms(spark):
    row = spark.range(1).select(stats.cluster_p(F.lit(0.01), F.lit(3)).alias("p"), stats.significant_digits(F.lit(123456.0), 2).alias("s")).first()
    assert round(row.p, 6) == 0.029701 and row.s == 120000.0
    assert models.chi_square_survival(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert models.chi_square_survival(4, 2) == pytest.approx(0.135335, abs=1e-6)


def test_special_functions():
    x = np.array([1e-6, 0.3, 1.0, 5.5, 1000.0])
    assert np.allclose(models.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize(("multi", "robust"), [(True, False), (True, True), (False, False)])
def test_gradients(multi, robust):
    rng = np.random.default_rng(1)
    x, y = np.c_[np.ones(12), np.arange(12) % 2], rng.poisson(6, (12, 3)).astype(float)
    t = rng.normal(0, 0.3, 6 + (3 if multi else 1) + robust)
    f = lambda v: brute_models.dm_negative(v, x, y, multi, robust, 1.0001, 1e-4, (1.01, 100.0))
    numeric = [(f(t + 1e-6 * e)[0] - f(t - 1e-6 * e)[0]) / 2e-6 for e in np.eye(len(t))]
    assert np.allclose(f(t)[1], numeric, atol=1e-4)


def test_two_categories_agree_with_beta_binomial():
    rng = np.random.default_rng(1)
    g = rng.normal(size=100)
    ns = rng.poisson(10, 100)
    ys = rng.binomial(ns, 1 / (1 + np.exp(-(0.3 + 0.3 * g)))).astype(float)
    x = np.c_[np.ones(100), g]
    bb = models.bb_test(ys, ns.astype(float), x, x[:, :1])
    dm = brute_models.dm_anova(x, x[:, :1], np.c_[ys, ns - ys], multi=False)
    assert dm[0] == pytest.approx(bb.loglr, abs=1e-3) and dm[4].conc[0] == pytest.approx(bb.conc, rel=0.01)


def test_tails_sum_to_one():
    alpha = np.array([2.0, 5.0])
    (right, _), (left, _) = brute_models.bb_tails(np.array([4, 6]), alpha)
    assert right + brute_models.bb_tails(np.array([3, 7]), alpha)[1][0] == pytest.approx(1.0)
    assert np.allclose(brute_models.bb_tails(np.array([4, 6]), alpha, 3), brute_models.bb_tails(np.array([4, 6]), alpha))
    assert 0 < left < 1


def cells(spark, shift):
    rng, rows = np.random.default_rng(2), []
    for s in range(8):
        share = np.array([0.5, 0.3, 0.2]) if s < 4 or not shift else np.array([0.1, 0.3, 0.6])
        rows += [(1, a, 10 * a, f"S{s}", int(n), 0) for a, n in enumerate(rng.multinomial(100, share), 1)]
    return spark.createDataFrame(rows, "clu long, a long, b long, sample string, n long, tot long")


def test_differential_usage(spark):
    groups = spark.createDataFrame([(f"S{i}", "A" if i < 4 else "B") for i in range(8)], "sample string, grp string")
    far, same = (differential.differential_usage(cells(spark, s), groups, min_samples_per_group=3).first() for s in (True, False))
    assert far.status == same.status == "Success" and far.p < 1e-6 < same.p and far.df == 2
    assert sum(i.deltapsi for i in far.introns) == pytest.approx(0, abs=1e-9)
    assert far.introns[2].deltapsi == pytest.approx(0.4, abs=0.1)


def test_outliers(spark):
    got = outlier.outliers(cells(spark, False)).collect()
    assert len(got) == 24 and all(0 < r.p <= 1 for r in got)
    assert outlier.cluster_outliers(spark.createDataFrame(got)).count() == 8


def regression(rng, samples, introns, covariates, bad=0):
    """Covariates and counts of one cluster; ``bad`` samples have flat shares."""
    x = np.c_[np.ones(samples), rng.standard_normal((samples, covariates - 1))]
    share = np.exp(x @ rng.standard_normal((covariates, introns)) * 0.7)
    share /= share.sum(axis=1, keepdims=True)
    alpha = np.where(np.arange(samples)[:, None] < bad, 1.0, 80 * share)
    return x, np.array([rng.multinomial(rng.integers(40, 300), rng.dirichlet(a)) for a in alpha]).astype(float)


@pytest.mark.parametrize(("multi", "robust"), [(True, False), (False, False), (True, True)])
def test_fits_by_rounds_reach_the_optimum(spark, multi, robust):
    """No worse than the optimiser of one cluster at a time from the same start, and a gradient of nothing."""
    rng, rows, data = np.random.default_rng(5), [], {}
    for clu in range(6):
        k, bad = 2 + clu % 4, 2 if robust else 0
        x, y = regression(rng, 24, k, 2, bad)
        start = np.concatenate([np.zeros(2 * k), np.full(k if multi else 1, np.log(10.0))])
        data[clu] = (x, y, start)
        rows.append((clu, k, [(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], start.tolist()))
    frame = spark.createDataFrame(rows, "clu long, k int, obs array<struct<x:array<double>,y:array<double>>>, start array<double>")
    model = rounds.Model(2, multi=multi, robust=robust)
    found = rounds.fitted(frame, model).collect()
    assert len(found) == 6 and all(r.converged for r in found)
    for r in found:
        x, y, start = data[r.clu]
        f = lambda t: brute_models.dm_negative(t, x, y, multi, robust, model.shape, model.rate, model.prior)  # noqa: B023, E731
        other = models.minimise(f, np.append(start, np.log(0.01 / 0.99)) if robust else start, 4000, tolerance=1e-13)[1]
        theta = np.append(r.theta, np.log(r.share / (1 - r.share))) if robust else np.array(r.theta)
        value, gradient = f(theta)
        assert value == pytest.approx(-r.value, abs=1e-3 if robust else 1e-6) and (robust or -r.value <= other + 1e-3)  # a mixture has several optima
        assert np.abs(gradient).max() < 0.05
    # two introns can't tell an outlier from a sample of few reads, more of them can
    assert not robust or max(r.share for r in found) > 0.01 and all(r.share < 0.1 for r in found)
    few = rounds.fitted(frame, model, rounds=2).collect()
    assert len(few) == 6 and not any(r.converged for r in few) and all(r.rounds == 2 for r in few)


def test_timeout_is_a_status(spark):
    groups = spark.createDataFrame([(f"S{i}", "A" if i < 4 else "B") for i in range(8)], "sample string, grp string")
    assert differential.differential_usage(cells(spark, True), groups, min_samples_per_group=3, rounds=2).first().status == "timeout"


def test_a_constant_covariate_counts_for_nothing(spark):
    """Samples of the cluster that all have one batch: the fit is that without batches."""
    rows = [(f"S{i}", "A" if i < 4 else "B", float(i % 3), "x" if i < 8 else "y") for i in range(10)]
    groups = spark.createDataFrame(rows, "sample string, grp string, age double, batch string")
    with_batch, without = (differential.differential_usage(cells(spark, True), g, min_samples_per_group=3).first() for g in (groups, groups.drop("batch")))
    assert with_batch.loglr == pytest.approx(without.loglr, abs=1e-5) and with_batch.status == "Success"


def test_tails_by_terms(spark):
    """Against sums of probabilities, for few and many reads and parameters below and above one."""
    rng, rows = np.random.default_rng(3), []
    for tot in (0, 1, 7, 300):
        for alpha, rest in ((0.3, 0.4), (5.0, 20.0), (900.0, 100.0)):
            rows += [(int(n), tot, alpha, rest) for n in {0, tot, *rng.integers(0, tot + 1, 3)}]
    got = outlier.tails(spark.createDataFrame([tuple(map(float, r)) for r in rows], "n double, tot double, alpha double, rest double")).collect()
    for r in got:
        right, left = brute_models.bb_tails(np.array([r.n, r.tot - r.n]), np.array([r.alpha, r.rest]))
        assert r.p == pytest.approx(min(1.0, 2 * min(right[0], left[0])), rel=1e-7, abs=1e-11)


def test_special_functions(spark):
    from pyspark.sql import functions as F

    from intronaut.functions import special

    xs = [1e-6, 0.02, 0.5, 1.0, 3.7, 40.0, 1e5]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", *(F.expr(f("x")).alias(f.__name__) for f in (special.lgamma, special.digamma, special.trigamma, special.erfc))).collect()
    for r in rows:
        assert r.lgamma == pytest.approx(math.lgamma(r.x), rel=1e-11, abs=1e-11) and r.digamma == pytest.approx(float(models.digamma(r.x)), rel=1e-10)
        assert r.trigamma == pytest.approx(float(models.digamma(r.x * (1 + 1e-5)) - models.digamma(r.x * (1 - 1e-5))) / (2e-5 * r.x), rel=1e-4)
        assert r.erfc == pytest.approx(math.erfc(r.x), rel=1e-9, abs=1e-300)
    grid = spark.createDataFrame([(x, n) for x in (0.0, 0.3, 4.0, 18.0, 70.0) for n in range(1, 9)], "x double, df int").select("x", "df", stats.chi_square_p("x", "df").alias("p")).collect()
    assert all(r.p == pytest.approx(models.chi_square_survival(r.x, r.df), rel=1e-9) for r in grid)


def test_fits_of_a_batch_are_those_of_single_clusters(spark):
    """Clusters of several sizes and numbers of samples side by side, and each alone."""
    rng, rows = np.random.default_rng(8), []
    for clu in range(5):
        x, y = regression(rng, 12 + clu % 3 * 5, 2 + clu % 2, 2)
        rows.append((clu, y.shape[1], [(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], [0.0] * (2 * y.shape[1]) + [2.0] * y.shape[1]))
    frame = spark.createDataFrame(rows, "clu long, k int, obs array<struct<x:array<double>,y:array<double>>>, start array<double>")
    whole = {r.clu: r for r in rounds.fitted(frame.coalesce(1), rounds.Model(2)).collect()}
    for clu in range(5):
        alone = rounds.fitted(frame.where(f"clu = {clu}"), rounds.Model(2)).first()
        assert alone.value == pytest.approx(whole[clu].value, abs=1e-9) and alone.rounds == whole[clu].rounds and len(alone.theta) == 3 * (2 + clu % 2)


def test_counts_of_the_fits_read_their_table_once(spark):
    """What the fits look at several times is written: no plan after it goes back to the line items."""
    from intronaut import catalog

    assert not any("lineitem" in f for made in (catalog._counts, catalog._some_clusters) for f in made(spark, "/root/testdata/sf0.001").inputFiles())


def test_tails_of_many_reads_take_few_terms():
    """Ten thousand counts of a million reads each, term by term ten thousand million terms; three of them against the whole sum."""
    import time

    tot, n = np.full(10_000, 1e6), np.linspace(0, 1e6, 10_000).round()
    begun = time.monotonic()
    got = outlier._two_sided(n, tot, np.full(10_000, 4.0), np.full(10_000, 16.0))
    assert time.monotonic() - begun < 60
    c = np.arange(1e6 + 1)
    pmf = np.exp(outlier.lgamma(1e6 + 1) - outlier.lgamma(c + 1) - outlier.lgamma(1e6 - c + 1) + outlier.lgamma(c + 4) + outlier.lgamma(1e6 - c + 16) - outlier.lgamma(1e6 + 20) + outlier.lgamma(20.0) - outlier.lgamma(4.0) - outlier.lgamma(16.0))
    for i in (500, 2_000, 5_000):
        k = int(n[i])
        assert got[i] == pytest.approx(min(1.0, 2 * min(pmf[k:].sum(), pmf[: k + 1].sum())), abs=1e-8)
