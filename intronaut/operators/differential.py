"""Differential usage between two groups: testability, fits of all clusters by rounds, result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from intronaut.functions.rounds import Model, fitted
from intronaut.functions.special import backward, chi_square_survival, cholesky, forward, lgamma, total
from intronaut.functions.stats import adjusted_fdr
from intronaut.scratch import materialize

# What a result table says of a cluster.
TOO_MANY, ONE_JUNCTION = "Too many introns in cluster", "<=1 junction in cluster"
NO_COVERAGE, LOW_COVERAGE = "<=1 sample with coverage>0", "<=1 sample with coverage>min_coverage"
FEW_INTRONS, FEW_SAMPLES = "<2 introns used in >=min_samples_per_intron samples", "Not enough valid samples"
SUCCESS, TIMEOUT = "Success", "timeout"
#: Ridge of the regression of log shares that fits start from, and the concentration they start with.
RIDGE, START_CONC = 0.001, 10.0


def testability(counts: DataFrame, groups: DataFrame, max_size: int | None = None, min_samples_per_intron: int = 5, min_samples_per_group: int = 4, min_coverage: int = 20) -> DataFrame:
    """(clu, status): the first reason not to test a cluster, null if there is none.

    ``counts`` has clu, a, b, sample, n, tot; samples that ``groups`` (sample, grp; one row per sample, so
    small enough for every task) lacks don't count.
    """
    cells = counts.join(F.broadcast(groups.select("sample", "grp")), "sample")
    introns = cells.groupBy("clu", "a", "b").agg(F.count_if(F.col("n") > 0).alias("used")).groupBy("clu").agg(F.count("*").alias("size"), F.count_if(F.col("used") >= min_samples_per_intron).alias("usable"))
    samples = cells.groupBy("clu", "sample", "grp").agg(F.sum("n").alias("tot"))
    by_group = samples.groupBy("clu", "grp").agg(F.count_if(F.col("tot") > 0).alias("seen"), F.count_if(F.col("tot") >= min_coverage).alias("covered"))
    valid = by_group.groupBy("clu").agg(F.sum("seen").alias("seen"), F.sum("covered").alias("covered"), F.count_if(F.col("covered") >= min_samples_per_group).alias("groups"))
    cap = F.lit(False) if max_size is None else F.col("size") > max_size
    status = (
        F.when(cap, TOO_MANY)
        .when(F.col("size") <= 1, ONE_JUNCTION)
        .when(F.col("seen") <= 1, NO_COVERAGE)
        .when(F.col("covered") <= 1, LOW_COVERAGE)
        .when(F.col("usable") < 2, FEW_INTRONS)
        .when(F.col("groups") < 2, FEW_SAMPLES)
    )
    return introns.join(valid, "clu").select("clu", status.alias("status"))


def design(groups: DataFrame) -> DataFrame:
    """Samples with their columns of the model matrix: group as 0/1 with the smaller level as 0, numeric
    covariates standardised by the sample deviation, others one column for each level but the smallest.

    ``groups`` has sample, grp and covariates, one row per sample; the driver looks at the levels alone.
    """
    levels = [r.grp for r in groups.select("grp").distinct().orderBy("grp").collect()]
    if len(levels) != 2:
        raise ValueError("two groups are compared")
    columns, numeric = [F.when(F.col("grp") == levels[1], 1.0).otherwise(0.0).alias("group")], {f.name for f in groups.schema if isinstance(f.dataType, NumericType)}
    for c in groups.columns:
        if c in ("sample", "grp"):
            continue
        if c in numeric:
            mean, spread = groups.agg(F.avg(c), F.stddev(c)).first()
            columns.append(((F.col(c) - F.lit(mean)) / F.lit(spread) if spread else F.lit(0.0)).alias(c))
        else:
            found = [r[0] for r in groups.select(c).distinct().orderBy(c).collect()]
            columns += [F.when(F.col(c) == level, 1.0).otherwise(0.0).alias(f"{c}{level}") for level in found[1:]]
    return groups.select("sample", *columns)


def observations(counts: DataFrame, samples: DataFrame, min_samples_per_intron: int = 0) -> DataFrame:
    """A row per cluster: clu, k, introns (a, b; ordered) and obs, its samples with reads as structs of ``x`` and counts ``y``.

    ``samples`` has sample and x (array of double), one row per sample. Introns with reads in fewer than ``min_samples_per_intron``
    samples are left out. A covariate that is the same in all samples of a cluster counts as 0, but for the first (the intercept) and the last one.
    """
    cells = counts.groupBy("clu", "a", "b", "sample").agg(F.sum("n").cast("double").alias("n")).join(F.broadcast(samples), "sample")
    per_sample = cells.groupBy("clu", "sample").agg(F.first("x").alias("x"), F.map_from_entries(F.collect_list(F.struct(F.struct("a", "b"), "n"))).alias("cells"), F.sum("n").alias("tot")).where("tot > 0")
    used = cells.groupBy("clu", "a", "b").agg(F.count_if(F.col("n") > 0).alias("used")).where(F.col("used") >= min_samples_per_intron)
    introns = used.groupBy("clu").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("introns"))
    met = per_sample.join(introns, "clu").withColumn("y", F.expr("transform(introns, i -> coalesce(element_at(cells, i), 0D))"))
    collected = met.groupBy("clu").agg(F.first("introns").alias("introns"), F.expr("array_sort(collect_list(struct(sample, x, y)))").alias("rows"))
    fixed = "i > 0 and i < size(get(rows, 0).x) - 1 and array_min(transform(rows, r -> get(r.x, i))) = array_max(transform(rows, r -> get(r.x, i)))"
    flagged = collected.withColumn("fixed", F.expr(f"transform(get(rows, 0).x, (v, i) -> {fixed})"))
    # exploded and put together again, so that the flags are made once
    rows = flagged.select("clu", "introns", "fixed", F.posexplode("rows").alias("at", "r")).selectExpr("clu", "introns", "at", "zip_with(r.x, fixed, (v, f) -> if(f, 0D, v)) as x", "r.y as y")
    return rows.groupBy("clu").agg(F.first("introns").alias("introns"), F.expr("transform(array_sort(collect_list(struct(at, x, y))), r -> struct(r.x as x, r.y as y))").alias("obs")).selectExpr("clu", "size(introns) as k", "introns", "obs")


def _starts(rows: DataFrame, p: int, multi: bool) -> DataFrame:
    """``rows`` with ``start``: coefficients of a ridge regression of log shares on the covariates."""
    gram = f"transform(sequence(0, {p - 1}), i -> transform(sequence(0, i), l -> aggregate(obs, 0D, (s, o) -> s + get(o.x, i) * get(o.x, l)) + if(i = l, {RIDGE!r}D, 0D)))"
    share = f"ln((get(o.y, j) + 1) / ({total('o.y')} + k))"
    right = f"transform(sequence(0, k - 1), j -> transform(sequence(0, {p - 1}), i -> aggregate(obs, 0D, (s, o) -> s + get(o.x, i) * {share})))"
    found = rows.withColumn("factor", F.expr(cholesky(gram))).withColumn("betas", F.expr(f"transform({right}, b -> {backward('factor', forward('factor', 'b'))})"))
    conc = f"array_repeat(ln({START_CONC!r}D), {'k' if multi else '1'})"
    return found.withColumn("start", F.expr(f"concat(flatten(transform(sequence(0, {p - 1}), i -> transform(betas, b -> get(b, i)))), {conc})")).drop("factor", "betas")


def differential_usage(counts: DataFrame, groups: DataFrame, max_size: int | None = 10, min_samples_per_intron: int = 5, min_samples_per_group: int = 4, min_coverage: int = 20, robust: bool = False, multi: bool = True, rounds: int = 60) -> DataFrame:
    """Likelihood-ratio test of every testable cluster, all of them fitted together; untestable ones keep their status.

    Both models start from a regression of log shares; then each starts once more from where the other one ended,
    and the better of its two ends counts. A cluster with an end that still moved after ``rounds`` rounds has the
    status ``timeout`` beside what was reached. Returns clu, status, loglr, df, p and introns (a, b, logef, baseline, perturbed, deltapsi).
    """
    table = design(groups)
    names = [c for c in table.columns if c not in ("sample", "group")]
    status = materialize(testability(counts, groups, max_size, min_samples_per_intron, min_samples_per_group, min_coverage), "status")
    samples = table.select("sample", F.array(F.lit(1.0), *(F.col(c).cast("double") for c in names), "group").alias("x"))
    testable = counts.join(status.where("status is null").select("clu"), "clu", "left_semi")
    clusters = materialize(observations(testable, samples, min_samples_per_intron), "clusters")
    p, model = len(names) + 2, Model(len(names) + 2, multi=multi, robust=robust)
    # the smaller model is the larger one without the last covariate; clu tells them apart by its last bit
    less = f"transform(obs, o -> struct(transform(o.x, (v, i) -> if(i = {p - 1}, 0D, v)) as x, o.y as y))"
    both = clusters.select("clu", "k", "obs", F.explode(F.array(F.lit(0), F.lit(1))).alias("full")).selectExpr("clu * 2 + full as clu", "k", f"if(full = 1, obs, {less}) as obs")
    both = materialize(both, "models")
    first = fitted(_starts(both, p, multi), model, rounds)
    other = first.selectExpr("clu ^ 1 as clu", "theta", "share")
    swapped = both.join(other, "clu").selectExpr("clu", "k", "obs", f"transform(theta, (c, i) -> if(i div k = {p - 1} and i < {p} * k, 0D, c)) as start", "greatest(share, 1e-6D) as share")
    second = fitted(swapped, model, rounds)
    best = first.union(second).groupBy("clu").agg(F.max_by(F.struct("theta", "value", "share", "converged"), "value").alias("best"))
    ends = best.groupBy(F.expr("shiftright(clu, 1)").alias("clu")).agg(F.max_by("best", "clu").alias("large"), F.min_by("best", "clu").alias("small"))
    tested = ends.join(clusters.select("clu", "k", "introns"), "clu").selectExpr("clu", "k", "introns", "large.theta as theta", "large.converged and small.converged as converged", "large.value - small.value as loglr", "cast(k - 1 as bigint) as df")
    conc = f"get(theta, {p} * k + {'j' if multi else '0'})"
    mean = f"aggregate(slice(theta, {p - 1} * k + 1, k), 0D, (s, c) -> s + c) / k"
    parts = f"transform(introns, (i, j) -> struct(get(theta, {p - 1} * k + j) - {mean} as logef, get(theta, j) + {conc} as before, get(theta, j) + get(theta, {p - 1} * k + j) + {conc} as after))"
    shares = tested.withColumn("parts", F.expr(parts))
    for new, old in (("baseline", "before"), ("perturbed", "after")):
        e = f"exp(c.{old} - array_max(transform(parts, d -> d.{old})))"
        shares = shares.withColumn(new, F.expr(f"transform(transform(parts, c -> {e}), (v, j) -> v / aggregate(transform(parts, c -> {e}), 0D, (s, d) -> s + d))"))
    introns = "transform(introns, (i, j) -> struct(i.a as a, i.b as b, get(parts, j).logef as logef, get(baseline, j) as baseline, get(perturbed, j) as perturbed, get(perturbed, j) - get(baseline, j) as deltapsi))"
    done = shares.withColumn("statistic", F.expr("2 * loglr")).selectExpr("clu", f"if(converged, '{SUCCESS}', '{TIMEOUT}') as status", "loglr", "df", f"{chi_square_survival('statistic', 'df')} as p", f"{introns} as introns")
    rest = status.where("status is not null").select("clu", "status", *[F.lit(None).cast(t).alias(c) for c, t in (("loglr", "double"), ("df", "long"), ("p", "double"))], F.lit(None).cast(done.schema["introns"].dataType).alias("introns"))
    return materialize(done.union(rest), "tested")


def cluster_table(results: DataFrame) -> DataFrame:
    """status, loglr, df, p and adjusted p of each cluster."""
    return adjusted_fdr(results.select("clu", "status", "loglr", "df", "p"), "p", "p_adjust")


def effect_sizes(results: DataFrame) -> DataFrame:
    """A row per intron of the tested clusters."""
    return results.where("introns is not null").select("clu", F.inline("introns"))


def cluster_sizes(introns: DataFrame) -> DataFrame:
    """Introns of each cluster."""
    return introns.groupBy("clu").agg(F.count("*").alias("size"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """Samples of each group."""
    return groups.groupBy("grp").agg(F.count("*").alias("samples"))


def loglik_at(counts: DataFrame, conc: float) -> DataFrame:
    """(clu, loglik): Dirichlet-multinomial log likelihood of each cluster's samples at equal shares and one concentration."""
    sizes = counts.groupBy("clu").agg(F.count_distinct("a", "b").alias("k"))
    cells = counts.groupBy("clu", "a", "b", "sample").agg(F.sum("n").cast("double").alias("n")).join(sizes, "clu").withColumn("c", F.lit(conc) / F.col("k"))
    samples = cells.groupBy("clu", "sample").agg(F.sum("n").alias("tot"), F.expr(f"sum({lgamma('(c + n)')} - {lgamma('c')})").alias("parts"))
    return samples.withColumn("c", F.lit(conc)).groupBy("clu").agg(F.expr(f"sum(parts + {lgamma('c')} - {lgamma('(c + tot)')})").alias("loglik"))


def status_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))
