"""Small tests over one table of samples, in numpy: beta-binomial regression with Wald tests, Mahalanobis distances."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive numbers: Stirling's series after a shift by 8."""
    x = np.asarray(x, float)
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    y = x + 8
    i = 1 / (y * y)
    series = (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i * (1 / 1188 - i * 691 / 360360))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive numbers."""
    x = np.asarray(x, float)
    shift = sum(1 / (x + k) for k in range(8))
    y = x + 8
    i = 1 / (y * y)
    return np.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i * (5 / 660 - i * 691 / 32760))))) - shift


def chi_square_survival(x: float, df: int) -> float:
    """P(chi-square with integer ``df`` > x) by its finite sums."""
    if x <= 0:
        return 1.0
    h = x / 2
    if df % 2 == 0:
        term = total = math.exp(-h)
        for i in range(1, df // 2):
            term *= h / i
            total += term
        return min(1.0, total)
    total, term = math.erfc(math.sqrt(h)), math.exp(-h) * math.sqrt(h) / math.gamma(1.5)
    for i in range(1, (df + 1) // 2):
        total += term
        term *= h / (i + 0.5)
    return min(1.0, total)


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 400, memory: int = 10, tolerance: float = 1e-9) -> tuple[np.ndarray, float]:
    """Limited-memory BFGS with a backtracking line search; a cap on steps stands in for a time limit."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = g.copy(), []
        for s, y in reversed(pairs):
            a = s @ q / (s @ y)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= s @ y / (y @ y)
        else:
            q /= max(1.0, np.linalg.norm(g))
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - y @ q / (s @ y))
        slope = -(g @ q)
        if slope >= 0:
            q, slope, pairs = g, -(g @ g), []
        t = 1.0
        while t > 1e-12:
            new = x - t * q
            new_value, new_g = f(new)
            if np.isfinite(new_value) and new_value <= value + 1e-4 * t * slope:
                break
            t *= 0.5
        else:
            break
        s, y = new - x, new_g - g
        done = value - new_value <= tolerance * (abs(value) + 1e-3) and np.linalg.norm(new_g, np.inf) < 1e-2
        x, value, g = new, new_value, new_g
        if s @ y > 1e-12:
            pairs = [*pairs[-memory + 1 :], (s, y)]
        if done or np.linalg.norm(g, np.inf) < 1e-7:
            break
    return x, value


@dataclass
class BetaBinomialTest:
    loglr: float
    p: float
    loglr_fixed: float
    p_fixed: float
    coefficients: np.ndarray
    errors: np.ndarray
    wald_p: np.ndarray
    conc: float


def bb_negative(theta: np.ndarray, x: np.ndarray, ys: np.ndarray, ns: np.ndarray, shape: float, rate: float, log_conc: float | None = None) -> tuple[float, np.ndarray]:
    """Negative log posterior of the beta-binomial regression; the concentration is fixed if ``log_conc`` is given."""
    b = theta if log_conc is not None else theta[:-1]
    conc = math.exp(min(30.0, max(-30.0, log_conc if log_conc is not None else theta[-1])))
    q = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
    a1, a0 = conc * q, conc * (1 - q)
    value = (lgamma(a1 + ys) - lgamma(a1) + lgamma(a0 + ns - ys) - lgamma(a0) + lgamma(np.array(conc)) - lgamma(conc + ns)).sum()
    d1, d0 = digamma(a1 + ys) - digamma(a1), digamma(a0 + ns - ys) - digamma(a0)
    grad = x.T @ ((d1 - d0) * conc * q * (1 - q))
    if log_conc is not None:
        return -value, -grad
    value += (shape - 1) * math.log(conc) - rate * conc
    d_conc = (d1 * q + d0 * (1 - q) + digamma(np.array(conc)) - digamma(conc + ns)).sum() * conc + (shape - 1) - rate * conc
    return -value, -np.append(grad, d_conc)


def psd_inverse(m: np.ndarray, threshold: float = 0.01) -> np.ndarray:
    """Inverse of a symmetric matrix whose eigenvalues below the threshold count as the threshold."""
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    return (vectors / np.maximum(values, threshold)) @ vectors.T


def bb_test(ys: np.ndarray, ns: np.ndarray, x_full: np.ndarray, x_null: np.ndarray, shape: float = 1.0001, rate: float = 1e-4) -> BetaBinomialTest:
    """Beta-binomial regression: two likelihood-ratio tests (free and fixed concentration) and Wald tests."""
    share = ys / np.maximum(ns, 1)
    conc = min(1 / max(share.var(ddof=1) if len(share) > 1 else 1.0, 1e-12), 1000.0)
    mean = min(max(float(share.mean()), 0.001), 0.999)
    start = np.zeros(x_null.shape[1] + 1)
    start[0], start[-1] = math.log(mean / (1 - mean)), math.log(conc)
    null, v0 = minimise(lambda t: bb_negative(t, x_null, ys, ns, shape, rate), start)
    extra = x_full.shape[1] - x_null.shape[1]
    target = lambda t: bb_negative(t, x_full, ys, ns, shape, rate)
    full, v1 = minimise(target, np.concatenate([null[:-1], np.zeros(extra), null[-1:]]))
    at_full = lambda t: bb_negative(t, x_full, ys, ns, shape, rate, full[-1])
    _, w0 = minimise(lambda t: bb_negative(t, x_null, ys, ns, shape, rate, full[-1]), null[:-1])
    w1 = at_full(full[:-1])[0]
    h, n = 1e-4, len(full)
    hessian = np.array([(target(full + h * e)[1] - target(full - h * e)[1]) / (2 * h) for e in np.eye(n)])
    errors = np.sqrt(np.diag(psd_inverse(hessian)))[:-1]
    z = full[:-1] / errors
    wald = np.array([math.erfc(abs(x) / math.sqrt(2)) for x in z])
    return BetaBinomialTest(v0 - v1, chi_square_survival(2 * (v0 - v1), extra), w0 - w1, chi_square_survival(2 * (w0 - w1), extra), full[:-1], errors, wald, math.exp(full[-1]))


def mahalanobis(x: np.ndarray) -> np.ndarray:
    """Chi-square survival of each row's squared distance from the mean."""
    d = x - x.mean(axis=0)
    inverse = psd_inverse(np.cov(x, rowvar=False).reshape(x.shape[1], -1))
    return np.array([chi_square_survival(float(v @ inverse @ v), x.shape[1]) for v in d])


def sanitised(x: np.ndarray, eps: float = 1e-6) -> np.ndarray:
    """Shares kept within [eps, 1 - eps] and normalised."""
    y = np.clip(x, eps, 1 - eps)
    return y / y.sum()
