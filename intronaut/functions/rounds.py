"""Dirichlet-multinomial regressions of many clusters at once, by damped Newton steps on batches of rows.

A row of the table is a cluster with its samples (counts and covariates) and the parameters to start from. Spark deals the rows
to tasks; a task takes them in batches of clusters with equally many introns, and a step is a few array operations over
a batch: every sample becomes vectors over introns, and what pairs of introns add up to over the samples are the blocks of the
normal equations. Their Cholesky factor gives the next point. A point that is better is taken and damped less, else the old one is kept and
damped more. Clusters that gain no more leave the batch; those still there after the last step have not converged.
(The same steps as expressions of Spark's array functions, interpreted number by number, were slower.)

Parameters are coefficients (covariate by intron, softmax over introns) and logarithms of
concentrations, one for each intron or one for all. With a flat component a sample is an
outlier with some probability, which is estimated too: the posterior weights of the samples
come out of the two densities and weigh their rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from intronaut.functions.gamma import digamma, lgamma, trigamma
from intronaut.scratch import materialize

#: A cluster is done when a step of little damping gains less than this.
TOLERANCE = 1e-7
#: What the rounding of a log likelihood may take away from it, at least and as a share of the terms that it is the sum of.
NOISE, ROUNDING = 1e-9, float(np.finfo(float).eps)
#: Largest change of a parameter in one step, and largest logarithm of a concentration.
LARGEST_STEP, LARGEST_LOG = 3.0, 20.0
#: Damping: of the first step, by how much it falls and rises, its least value, and what counts as little.
DAMPING, FALL, RISE, LEAST, LITTLE = 1e-2, 5.0, 4.0, 1e-7, 1e-3
#: Numbers of the largest array of a batch, and clusters that a task has read at once.
NUMBERS, ROWS = 1 << 20, 256


@dataclass(frozen=True)
class Model:
    """Number of covariates, whether each intron has its own concentration, the gamma prior of concentrations and the beta prior of outliers."""

    covariates: int
    multi: bool = True
    shape: float = 1.0001
    rate: float = 1e-4
    robust: bool = False
    prior: tuple[float, float] = (1.01, 100.0)


def _curvature(model: Model, theta: np.ndarray, share: np.ndarray, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihoods, negative Hessians, gradients, weights of outliers and sizes of the terms of clusters at ``theta``, without the prior of concentrations.

    ``x`` (cluster, sample, covariate), ``y`` (cluster, sample, intron); ``real`` (cluster, sample) is 0 for samples that only fill up.
    a: parameters; r, q: first and second derivatives by their logarithms; z: curvature of their sum; w: row sums of the second derivatives.
    """
    many, k, p = len(theta), y.shape[2], model.covariates
    beta, conc = theta[:, : p * k].reshape(many, p, k), theta[:, p * k :]
    eta = np.einsum("csp,cpj->csj", x, beta)
    e = np.exp(eta - eta.max(axis=2, keepdims=True))
    s = e / e.sum(axis=2, keepdims=True)
    a = s * np.exp(conc)[:, None, :]
    all_a, n = a.sum(axis=2), y.sum(axis=2)
    # of each intron, and last of their sum
    low = np.concatenate([a, all_a[:, :, None]], axis=2)
    up = low + np.concatenate([y, n[:, :, None]], axis=2)
    above, below = lgamma(up), lgamma(low)
    terms = ((np.abs(above) + np.abs(below)).sum(axis=2) * real).sum(axis=1)
    gain, h, h2 = above - below, digamma(up) - digamma(low), trigamma(up) - trigamma(low)
    own = gain[:, :, :k].sum(axis=2) - gain[:, :, k]
    r = a * (h[:, :, :k] - h[:, :, k:])
    z = -h2[:, :, k]
    q = -a * a * h2[:, :, :k] - r
    w = q - (z * all_a)[:, :, None] * a
    weight = real
    if model.robust:
        flat = lgamma(np.full(n.shape, float(k))) - lgamma(k + n) + lgamma(y + 1).sum(axis=2)
        l0, l1 = np.log(1 - share)[:, None] + own, np.log(share)[:, None] + flat
        most = np.maximum(l0, l1)
        own = most + np.log(np.exp(l0 - most) + np.exp(l1 - most))
        weight = real * np.exp(l0 - own)
    value = (own * real).sum(axis=1)
    # blocks of pairs of introns: both concentrations, covariate and concentration, two covariates
    eye = np.eye(k)
    v = weight[:, :, None, None] * (eye * q[:, :, :, None] - z[:, :, None, None] * a[:, :, :, None] * a[:, :, None, :])
    t = v - (weight[:, :, None] * s)[:, :, :, None] * w[:, :, None, :]
    sum_r, sum_w = r.sum(axis=2), w.sum(axis=2)
    b = t + weight[:, :, None, None] * (s[:, :, :, None] * s[:, :, None, :] * sum_w[:, :, None, None] - w[:, :, :, None] * s[:, :, None, :] + sum_r[:, :, None, None] * (eye * s[:, :, :, None] - s[:, :, :, None] * s[:, :, None, :]))
    last, size = p * k, theta.shape[1]
    hessian, slope = np.empty((many, size, size)), np.empty((many, size))
    for m in range(p):
        for l in range(p):
            # the row's intron is the block's first one
            hessian[:, m * k : (m + 1) * k, l * k : (l + 1) * k] = np.einsum("cs,csji->cji", x[:, :, m] * x[:, :, l], b)
        slope[:, m * k : (m + 1) * k] = np.einsum("cs,csj->cj", x[:, :, m] * weight, r - s * sum_r[:, :, None])
        cross = np.einsum("cs,csji->cji", x[:, :, m], t)
        cross = cross if model.multi else cross.sum(axis=2, keepdims=True)
        hessian[:, m * k : (m + 1) * k, last:], hessian[:, last:, m * k : (m + 1) * k] = cross, cross.transpose(0, 2, 1)
    v, free = v.sum(axis=1), (weight[:, :, None] * r).sum(axis=1)
    hessian[:, last:, last:] = v if model.multi else v.sum(axis=(1, 2))[:, None, None]
    slope[:, last:] = free if model.multi else free.sum(axis=1)[:, None]
    return value, hessian, slope, ((1 - weight) * real).sum(axis=1), terms


def _solved(matrix: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of symmetric systems by their Cholesky factors, no numbers where a matrix isn't positive definite."""
    size, lower, out = right.shape[1], np.zeros_like(matrix), right.copy()
    for j in range(size):
        rest = matrix[:, j:, j] - np.einsum("cij,cj->ci", lower[:, j:, :j], lower[:, j, :j])
        root = np.sqrt(np.where(rest[:, 0] > 0, rest[:, 0], np.nan))
        lower[:, j:, j] = rest / root[:, None]
        lower[:, j, j] = root
        out[:, j] = (out[:, j] - np.einsum("cj,cj->c", lower[:, j, :j], out[:, :j])) / root
    for j in range(size - 1, -1, -1):
        out[:, j] = (out[:, j] - np.einsum("cj,cj->c", lower[:, j + 1 :, j], out[:, j + 1 :])) / lower[:, j, j]
    return out


def _ends(model: Model, rounds: int, start: np.ndarray, share: np.ndarray, x: np.ndarray, y: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, ...]:
    """theta, value, share, steps taken and whether they came to an end, for clusters with equally many introns."""
    many, size = start.shape
    last, (alpha, beta) = model.covariates * y.shape[2], model.prior
    theta, trial, share = start.copy(), start.copy(), share.copy()
    value, damping = np.full(many, -np.inf), np.full(many, DAMPING)
    hessian, slope, known = np.zeros((many, size, size)), np.zeros((many, size)), np.zeros(many, bool)
    done, steps, left = np.zeros(many, bool), np.zeros(many, np.int32), np.arange(many)
    samples = real.sum(axis=1)
    for _ in range(rounds):
        if not len(left):
            break
        tried, before, had = trial[left], share[left], damping[left]
        reached, h, g, outlying, terms = _curvature(model, tried, before, x[left], y[left], real[left])
        conc = tried[:, last:]
        reached = reached + ((model.shape - 1) * conc - model.rate * np.exp(conc)).sum(axis=1)
        if model.robust:
            reached = reached + (alpha - 1) * np.log(before) + (beta - 1) * np.log(1 - before)
        noise = NOISE + ROUNDING * terms
        better = reached >= value[left] - noise
        ended = np.where(better, (reached - value[left] < TOLERANCE) & (had < LITTLE), had > 1e9)
        at = left[better]
        theta[at], value[at], hessian[at], slope[at], known[at] = tried[better], reached[better], h[better], g[better], True
        if model.robust:  # the share that maximises the expected log posterior
            share[at] = ((outlying + alpha - 1) / (samples[left] + alpha + beta - 2))[better]
        damping[left] = np.where(better, np.maximum(had / FALL, LEAST), np.maximum(had * RISE, LITTLE))
        steps[left] += 1
        done[left] = ended
        left = left[~ended]
        # the next points, from the best ones so far
        here, conc = theta[left], np.exp(theta[left][:, last:])
        matrix, right, number = hessian[left], slope[left], np.arange(size)
        matrix[:, number[last:], number[last:]] += model.rate * conc
        right[:, last:] += model.shape - 1 - model.rate * conc
        own = matrix[:, number, number]
        matrix[:, number, number] = own + damping[left][:, None] * (np.abs(own) + 1e-6) + 1e-9
        step = _solved(matrix, right)
        good = known[left] & ~np.isnan(step).any(axis=1)
        moved = here + np.clip(step, -LARGEST_STEP, LARGEST_STEP)
        moved[:, last:] = np.clip(moved[:, last:], -LARGEST_LOG, LARGEST_LOG)
        trial[left] = np.where(good[:, None], moved, here)
        damping[left] = np.where(good, damping[left], np.maximum(damping[left] * RISE * FALL, LITTLE))
    return theta, value, share, steps, done


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(float)


def fitted(clusters: DataFrame, model: Model, rounds: int = 60) -> DataFrame:
    """Parameters of each cluster that maximise its log posterior.

    ``clusters`` has clu, k (number of introns, int), obs (array of structs of a sample's covariates ``x`` and
    counts ``y``, arrays of double), start (parameters) and, for a robust model, share (of outliers, to begin with). Returns clu, theta, value
    (log posterior), share, rounds (steps taken) and converged. A cluster whose posterior still rises after ``rounds`` steps
    comes back with what it has reached and ``converged`` false.
    """
    p, schema = model.covariates, "clu long, theta array<double>, value double, share double, rounds int, converged boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                obs = batch.column("obs")
                size, introns = np.diff(obs.offsets.to_numpy()), batch.column("k").to_numpy()
                flat, starts, at = obs.flatten(), batch.column("start"), np.concatenate([[0], np.cumsum(size)])
                covariates, counts = (_numbers(flat.field(c).flatten()) for c in ("x", "y"))
                begin, places = _numbers(starts.flatten()), np.concatenate([[0], np.cumsum(np.repeat(introns, size))])
                starts_at = np.concatenate([[0], np.cumsum(np.diff(starts.offsets.to_numpy()))])
                shares = _numbers(batch.column("share"))
                order = np.lexsort((size, introns))
                while len(order):
                    k = int(introns[order[0]])
                    same = order[introns[order] == k]
                    # samples of a piece are filled up to those of its last cluster
                    fits = max(1, NUMBERS // max(int(size[same].max()) * k * k, (p * k + k) ** 2))
                    piece, order = same[:fits], order[min(fits, len(same)) :]
                    most = int(size[piece].max())
                    x, y, real = np.zeros((len(piece), most, p)), np.zeros((len(piece), most, k)), np.zeros((len(piece), most))
                    for i, c in enumerate(piece):
                        s = size[c]
                        x[i, :s] = covariates[at[c] * p : at[c + 1] * p].reshape(s, p)
                        y[i, :s] = counts[places[at[c]] : places[at[c + 1]]].reshape(s, k)
                        real[i, :s] = 1
                    begun = np.stack([begin[starts_at[c] : starts_at[c + 1]] for c in piece])
                    with np.errstate(all="ignore"):
                        theta, value, share, steps, done = _ends(model, rounds, begun, shares[piece], x, y, real)
                    arrays = [batch.column("clu").take(pa.array(piece)).cast(pa.int64()), pa.array(list(theta), pa.list_(pa.float64())), pa.array(value), pa.array(share), pa.array(steps), pa.array(done)]
                    yield pa.record_batch(arrays, ["clu", "theta", "value", "share", "rounds", "converged"])

    share = "share" if "share" in clusters.columns else "0.01D as share"
    # a set number of tasks: the rows are few and the work for each is much
    tasks = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(clusters.selectExpr("clu", "k", "obs", "start", share).repartition(tasks, "clu").mapInArrow(run, schema), "fit")
