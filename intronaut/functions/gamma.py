"""Gamma functions of arrays, by the same series as the expressions of ``special``."""

from __future__ import annotations

import math

import numpy as np

from intronaut.functions.special import SHIFT


def _series(y: np.ndarray, *coefficients: float) -> np.ndarray:
    """c0 + c1 / y^2 + c2 / y^4 + ..."""
    out, square = coefficients[-1], y * y
    for c in coefficients[-2::-1]:
        out = c + out / square
    return out


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma of positive numbers: Stirling's series after a shift by 8."""
    y = x + SHIFT
    low, high = (math.prod((x + i for i in range(first + 1, first + 4)), start=x + first) for first in range(0, SHIFT, 4))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + _series(y, 1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360) / y - np.log(low) - np.log(high)


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of log gamma for positive numbers."""
    y = x + SHIFT
    return np.log(y) - 0.5 / y - _series(y, 1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760) / (y * y) - sum(1 / (x + i) for i in range(SHIFT))


def trigamma(x: np.ndarray) -> np.ndarray:
    """Second derivative of log gamma for positive numbers."""
    y = x + SHIFT
    return 1 / y + 0.5 / (y * y) + _series(y, 1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66) / (y * y * y) + sum(1 / ((x + i) * (x + i)) for i in range(SHIFT))
