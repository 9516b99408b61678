"""Dirichlet-multinomial models one cluster at a time, in numpy: what the native fits are compared with."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

from intronaut.functions.models import chi_square_survival, digamma, lgamma, minimise


@dataclass
class Fit:
    """Log posterior, centred coefficients (covariates x categories), concentrations, outlier share."""

    loglik: float
    beta: np.ndarray
    conc: np.ndarray
    outlier: float | None = None


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def dm_negative(theta: np.ndarray, x: np.ndarray, y: np.ndarray, multi: bool, robust: bool, shape: float, rate: float, prior: tuple[float, float]) -> tuple[float, np.ndarray]:
    """Negative log posterior of the Dirichlet-multinomial regression and its gradient.

    ``theta`` holds coefficients (centred over categories inside), log concentrations (one per category or one
    for all) and, if robust, the logit of the share of samples drawn from the flat component.
    """
    p, k = x.shape[1], y.shape[1]
    raw, rest = theta[: p * k].reshape(p, k), theta[p * k :]
    beta = raw - raw.mean(axis=1, keepdims=True)
    conc = np.exp(np.clip(rest[: k if multi else 1], -30, 30))
    s = _softmax(x @ beta)
    a = s * conc
    total, n = a.sum(axis=1), y.sum(axis=1)
    each = lgamma(total) + (lgamma(a + y) - lgamma(a)).sum(axis=1) - lgamma(total + n)
    da = (digamma(total) - digamma(total + n))[:, None] + digamma(a + y) - digamma(a)
    if robust:
        pi = 1 / (1 + np.exp(-rest[-1]))
        one = np.ones(k)
        flat = lgamma(np.array(float(k))) + (lgamma(one + y) - lgamma(one)).sum(axis=1) - lgamma(k + n)
        l0, l1 = np.log1p(-pi) + each, np.log(pi) + flat
        each = np.logaddexp(l0, l1)
        w = np.exp(l0 - each)
        da = da * w[:, None]
        d_pi = ((1 - w) / pi - w / (1 - pi)).sum() + (prior[0] - 1) / pi - (prior[1] - 1) / (1 - pi)
    value = each.sum() + ((shape - 1) * np.log(conc) - rate * conc).sum()
    da_conc = da * s
    d_conc = (da_conc.sum(axis=0) if multi else np.array([da_conc.sum()])) * conc + (shape - 1) - rate * conc
    ds = da * conc
    d_eta = s * (ds - (ds * s).sum(axis=1, keepdims=True))
    d_beta = x.T @ d_eta
    d_beta -= d_beta.mean(axis=1, keepdims=True)
    parts = [d_beta.ravel(), d_conc]
    if robust:
        value += (prior[0] - 1) * np.log(pi) + (prior[1] - 1) * np.log1p(-pi)
        parts.append(np.array([d_pi * pi * (1 - pi)]))
    return -value, -np.concatenate(parts)


def dm_fit(x: np.ndarray, y: np.ndarray, start: Fit | None = None, multi: bool = True, robust: bool = False, shape: float = 1.0001, rate: float = 1e-4, prior: tuple[float, float] = (1.01, 100.0), ridge: float = 0.001) -> Fit:
    """Fit from ``start`` (padded with zeros for further covariates) or from a ridge regression of log shares."""
    p, k = x.shape[1], y.shape[1]
    if start is None:
        share = np.log((y + 1) / (y + 1).sum(axis=1, keepdims=True))
        beta = np.linalg.solve(x.T @ x + ridge * np.eye(p), x.T @ share)
        conc = np.full(k if multi else 1, 10.0)
        out = 0.01
    else:
        beta = np.zeros((p, k))
        beta[: min(p, len(start.beta))] = start.beta[:p]
        conc, out = start.conc, start.outlier or 0.01
    theta = np.concatenate([beta.ravel(), np.log(conc), [math.log(out / (1 - out))] if robust else []])
    theta, value = minimise(lambda t: dm_negative(t, x, y, multi, robust, shape, rate, prior), theta)
    raw = theta[: p * k].reshape(p, k)
    n = k if multi else 1
    return Fit(-value, raw - raw.mean(axis=1, keepdims=True), np.exp(np.clip(theta[p * k : p * k + n], -30, 30)), float(1 / (1 + np.exp(-theta[-1]))) if robust else None)


def dm_anova(x_full: np.ndarray, x_null: np.ndarray, y: np.ndarray, fit_null: Fit | None = None, **options) -> tuple[float, int, float, Fit, Fit]:
    """(loglr, df, p, null, full) of the likelihood-ratio test; ``x_null`` are the leading columns of ``x_full``.

    A small p-value is checked by refitting the null model from the full one's solution.
    """
    null = fit_null or dm_fit(x_null, y, **options)
    full = dm_fit(x_full, y, null, **options)
    df = (x_full.shape[1] - x_null.shape[1]) * (y.shape[1] - 1)
    p = chi_square_survival(2 * (full.loglik - null.loglik), df)
    if p < 0.001:
        again = dm_fit(x_null, y, full, **options)
        if again.loglik > null.loglik:
            null = again
            p = chi_square_survival(2 * (full.loglik - null.loglik), df)
    return full.loglik - null.loglik, df, p, null, full


def to_psi(beta: np.ndarray, conc: np.ndarray) -> np.ndarray:
    """Usage shares of a coefficient vector: softmax times concentration, normalised."""
    e = np.exp(beta - beta.max()) * conc
    return e / e.sum()


def dm_concentration(y: np.ndarray) -> np.ndarray:
    """Maximum-likelihood parameters of one Dirichlet-multinomial for all rows."""
    n = y.sum(axis=1)

    def f(t: np.ndarray) -> tuple[float, np.ndarray]:
        a = np.exp(np.clip(t, -20, 20))
        s = a.sum()
        value = (lgamma(a + y) - lgamma(a)).sum() + (lgamma(np.array(s)) - lgamma(s + n)).sum()
        g = (digamma(a + y) - digamma(a)).sum(axis=0) + (digamma(np.array(s)) - digamma(s + n)).sum()
        return -value, -g * a

    mean = y.mean(axis=0) + 0.5
    return np.exp(minimise(f, np.log(mean / mean.sum() * 10))[0])


def bb_tails(counts: np.ndarray, alpha: np.ndarray, columns: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(right, left) tail probabilities of each count of one sample under a Dirichlet-multinomial, both including it, within [eps, 1 - eps].

    A count is beta-binomial out of the sample's total. All counts share one table of probabilities, built in
    pieces of ``columns`` numbers of reads, so memory does not grow with the total.
    """
    counts, alpha = np.asarray(counts, int), np.asarray(alpha, float)
    total, rest = int(counts.sum()), alpha.sum() - alpha
    fixed = lgamma(np.array(total + 1.0)) - lgamma(np.array(total + alpha.sum())) + lgamma(np.array(alpha.sum())) - lgamma(alpha) - lgamma(rest)
    below, upto = np.zeros(len(counts)), np.zeros(len(counts))
    for first in range(0, total + 1, columns):
        k = np.arange(first, min(total + 1, first + columns), dtype=float)
        pmf = np.exp(fixed[:, None] - lgamma(k + 1) - lgamma(total - k + 1) + lgamma(k + alpha[:, None]) + lgamma(total - k + rest[:, None]))
        below += np.where(k < counts[:, None], pmf, 0).sum(axis=1)
        upto += np.where(k <= counts[:, None], pmf, 0).sum(axis=1)
    eps = np.finfo(float).eps
    return np.clip(1 - below, eps, 1 - eps), np.clip(upto, eps, 1 - eps)
