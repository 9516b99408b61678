"""Statistics as DataFrame expressions: adjusted p-values, ranks, normal quantiles, row scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intronaut.functions.special import chi_square_survival
from intronaut.scratch import materialize

# Coefficients of algorithm AS 241 (PPND16), numerators and denominators by power.
AS241 = {
    "central": (
        (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
        (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
    ),
    "near": (
        (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    ),
    "far": (
        (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    ),
}


def _polynomial(x: Column, coefficients: tuple[float, ...]) -> Column:
    out = F.lit(coefficients[-1])
    for c in coefficients[-2::-1]:
        out = out * x + F.lit(c)
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, to about 16 digits; null outside (0, 1)."""
    q = p - 0.5
    central = q * _polynomial(F.lit(0.180625) - q * q, AS241["central"][0]) / _polynomial(F.lit(0.180625) - q * q, AS241["central"][1])
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    near = _polynomial(r - 1.6, AS241["near"][0]) / _polynomial(r - 1.6, AS241["near"][1])
    far = _polynomial(r - 5.0, AS241["far"][0]) / _polynomial(r - 5.0, AS241["far"][1])
    tail = F.when(r <= 5.0, near).otherwise(far)
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, central).when(q < 0, -tail).otherwise(tail))


def adjusted_fdr(df: DataFrame, p: str, out: str, *by: str) -> DataFrame:
    """Benjamini-Hochberg over the rows of ``by`` (default all) with a p-value; null stays null.

    Without ``by`` no single task sees all rows: they are written once (a range exchange looks at its input twice), range-partitioned by p-value and written again, a row's rank is
    its place in its partition after the partitions before, and the running minimum from the largest
    p-value down is one within the partition and one over the partitions' minima.
    """
    if by:
        w = Window.partitionBy(*by)
        n, rank = F.count(p).over(w), F.count(p).over(w.orderBy(F.asc_nulls_last(p)).rowsBetween(Window.unboundedPreceding, 0))
        scaled = df.withColumn("_scaled", F.col(p) * n / rank)
        least = F.min("_scaled").over(w.orderBy(F.desc_nulls_first(p)).rangeBetween(Window.unboundedPreceding, 0))
        return scaled.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop("_scaled")
    ordered = materialize(materialize(df, "adjusted").repartitionByRange(F.asc_nulls_last(p)).sortWithinPartitions(F.asc_nulls_last(p)).withColumn("_at", F.monotonically_increasing_id()), "p_values")
    part = F.shiftright("_at", 33)
    pieces = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"), F.count(p).alias("_known"), F.min("_at").alias("_first"))
    # one row per partition of the range exchange from here on
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_n", F.sum("_known").over(Window.partitionBy()))
    ranked = ordered.withColumn("_part", part).join(F.broadcast(pieces), "_part")
    ranked = ranked.withColumn("_scaled", F.col(p) * F.col("_n") / (F.col("_before") + F.col("_at") - F.col("_first") + 1))
    later = ranked.groupBy("_part").agg(F.min("_scaled").alias("_least")).withColumn("_later", F.min("_least").over(Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))).drop("_least")
    own = F.min("_scaled").over(Window.partitionBy("_part").orderBy(F.desc_nulls_first(p)).rangeBetween(Window.unboundedPreceding, 0))
    adjusted = ranked.withColumn("_own", own).join(F.broadcast(later), "_part")
    return adjusted.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.col("_own"), F.col("_later")))).select(*df.columns, out)


def bonferroni_min(df: DataFrame, p: str, out: str, *by: str) -> DataFrame:
    """Smallest p-value of a group times the number of its p-values, 1 at most; null for a group without p-values."""
    return df.groupBy(*by).agg(F.when(F.count(p) > 0, F.least(F.lit(1.0), F.min(p) * F.count(p))).alias(out))


def fisher_combined(df: DataFrame, p: str, out: str, *by: str) -> DataFrame:
    """Chi-square survival of -2 sum(log p) at twice as many degrees of freedom as p-values, in its finite sum.

    Terms are kept as logarithms, so a first term below the smallest double loses nothing. A p-value of 0 gives 0.
    """
    half = df.groupBy(*by).agg((-F.sum(F.log(p))).alias("_half"), F.count(p).cast("int").alias("_n"), F.min(p).alias("_least"))
    term = F.aggregate(
        F.sequence(F.lit(1), F.col("_n")),
        F.struct(F.lit(0.0).alias("total"), (-F.col("_half")).alias("log_term")),
        lambda s, i: F.struct((s["total"] + F.exp(s["log_term"])).alias("total"), (s["log_term"] + F.log(F.col("_half") / i)).alias("log_term")),
        lambda s: F.least(F.lit(1.0), s["total"]),
    )
    # no logarithm of 0: neither of a p-value nor of the sum when all of them are 1
    combined = F.when(F.col("_n") == 0, None).when(F.col("_least") <= 0, 0.0).when(F.col("_half") <= 0, 1.0).otherwise(term)
    return half.withColumn(out, combined).drop("_half", "_n", "_least")


def cluster_p(least: Column, n: Column) -> Column:
    """1 - (1 - p)^n without loss for small p; 1 for a p of 1, which has no logarithm."""
    return F.when(least < 1, -F.expm1(n * F.log1p(-least))).when(least >= 1, 1.0)


def average_rank(value: str, *by: str) -> Column:
    """Rank within ``by`` with the mean rank for ties."""
    w = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def qqnorm(df: DataFrame, value: str, out: str, *by: str) -> DataFrame:
    """Values of each group replaced by normal quantiles of their ranks."""
    n = F.count("*").over(Window.partitionBy(*by))
    shift = F.when(n <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    return df.withColumn(out, normal_quantile((average_rank(value, *by) - shift) / (n + 1 - 2 * shift)))


def significant_digits(x: Column, digits: int) -> Column:
    """``x`` rounded to so many significant digits; 0 and null stay."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - digits + 1)
    return F.when(x == 0, x).otherwise(F.round(x / scale) * scale)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax_over(x: Column, *by: str) -> Column:
    """exp(x) / sum exp(x) within ``by``, the largest exponent taken out first."""
    w = Window.partitionBy(*by)
    e = F.exp(x - F.max(x).over(w))
    return e / F.sum(e).over(w)


def beta_real(raw: Column, scale: Column, *by: str) -> Column:
    """Coefficients on the real scale from shares of a simplex: (raw - 1/K) * scale, K the rows of ``by``."""
    return (raw - 1 / F.count("*").over(Window.partitionBy(*by))) * scale


def chi_square_p(x: str, df: str) -> Column:
    """P(chi-square with integer ``df`` > x) of two named columns; null for a null."""
    return F.expr(chi_square_survival(x, df))
