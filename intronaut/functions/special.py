"""Gamma functions and small dense linear algebra as SQL expressions, for use inside array functions too.

Arguments are names (of columns or of lambda variables): they occur many times in the result.
"""

from __future__ import annotations

import math

#: Terms of the recurrence before the asymptotic series is used.
SHIFT = 8


def _series(y: str, *coefficients: float) -> str:
    """c0 + c1 / y^2 + c2 / y^4 + ..."""
    out = f"{coefficients[-1]!r}D"
    for c in coefficients[-2::-1]:
        out = f"({c!r}D + {out} / ({y} * {y}))"
    return out


def lgamma(x: str) -> str:
    """Log gamma of a positive number: Stirling's series after a shift by 8."""
    y = f"({x} + {SHIFT})"
    shift = " + ".join(f"ln({' * '.join(f'({x} + {i})' for i in range(first, first + 4))})" for first in range(0, SHIFT, 4))
    return f"(({y} - 0.5D) * ln{y} - {y} + {0.5 * math.log(2 * math.pi)!r}D + {_series(y, 1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)} / {y} - {shift.replace(' + ln', ' - ln')})"


def digamma(x: str) -> str:
    """Derivative of log gamma for positive numbers."""
    y = f"({x} + {SHIFT})"
    shift = " - ".join(f"1 / ({x} + {i})" for i in range(SHIFT))
    return f"(ln{y} - 0.5D / {y} - {_series(y, 1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760)} / ({y} * {y}) - {shift})"


def trigamma(x: str) -> str:
    """Second derivative of log gamma for positive numbers."""
    y = f"({x} + {SHIFT})"
    shift = " + ".join(f"1 / (({x} + {i}) * ({x} + {i}))" for i in range(SHIFT))
    return f"(1 / {y} + 0.5D / ({y} * {y}) + {_series(y, 1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66)} / ({y} * {y} * {y}) + {shift})"


def total(values: str) -> str:
    """Sum of an array of doubles."""
    return f"aggregate({values}, 0D, (s_, v_) -> s_ + v_)"


def dot(x: str, y: str) -> str:
    """Sum of the products of two arrays of one length."""
    return total(f"zip_with({x}, {y}, (a_, b_) -> a_ * b_)")


def cholesky(lower: str) -> str:
    """Rows of the Cholesky factor of a matrix given by the rows of its lower triangle; nulls where it isn't positive definite.

    A row is begun from the left: its next entry needs what there is of it and the row above of that place, the last one its own squares.
    """
    above = dot("begun_", "slice(get(known_, size(begun_)), 1, size(begun_))")
    off = f"(m_ - {above}) / get(get(known_, size(begun_)), size(begun_))"
    root = f"sqrt(nullif(greatest(m_ - {total('transform(begun_, c_ -> c_ * c_)')}, 0D), 0D))"
    entry = f"aggregate(row_, cast(array() as array<double>), (begun_, m_) -> array_append(begun_, if(size(begun_) < size(known_), {off}, {root})))"
    return f"aggregate({lower}, cast(array() as array<array<double>>), (known_, row_) -> array_append(known_, {entry}))"


def forward(factor: str, b: str) -> str:
    """Solution of the lower triangular system of a Cholesky factor."""
    return f"aggregate({factor}, cast(array() as array<double>), (x_, r_) -> array_append(x_, (get({b}, size(x_)) - {dot('x_', 'slice(r_, 1, size(x_))')}) / get(r_, size(x_))))"


def backward(factor: str, b: str) -> str:
    """Solution of the transposed system, the last unknown first."""
    below = f"transform(slice({factor}, e_.i + 2, size({factor}) - e_.i - 1), r_ -> get(r_, e_.i))"
    return f"aggregate(reverse(transform({b}, (v_, i_) -> struct(v_ as v, i_ as i))), cast(array() as array<double>), (x_, e_) -> concat(array((e_.v - {dot(below, 'x_')}) / get(get({factor}, e_.i), e_.i)), x_))"


def erfc(x: str) -> str:
    """Complementary error function of a number of at least 0: a series of positive terms below 3, a continued fraction from there on."""
    root = f"{1 / math.sqrt(math.pi)!r}D"
    series = f"aggregate(sequence(0, 80), struct({x} as term, {x} as sum), (s_, n_) -> struct(s_.term * 2 * {x} * {x} / (2 * n_ + 3) as term, s_.sum + s_.term * 2 * {x} * {x} / (2 * n_ + 3) as sum), s_ -> 1 - 2 * {root} * exp(-{x} * {x}) * s_.sum)"
    fraction = f"{root} * exp(-{x} * {x}) / ({x} + aggregate(sequence(60, 1, -1), 0D, (t_, n_) -> n_ / 2D / ({x} + t_)))"
    return f"if({x} < 3, {series}, {fraction})"


def chi_square_survival(x: str, df: str) -> str:
    """P(chi-square with integer ``df`` > x) by its finite sums, null for a null."""
    h = f"(greatest({x}, 0D) / 2)"
    even = f"aggregate(if({df} < 4, cast(array() as array<int>), sequence(1, int({df} div 2) - 1)), struct(exp(-{h}) as term, exp(-{h}) as sum), (s_, n_) -> struct(s_.term * {h} / n_ as term, s_.sum + s_.term * {h} / n_ as sum), s_ -> s_.sum)"
    first = f"exp(-{h}) * sqrt({h}) / {math.gamma(1.5)!r}D"
    odd = f"aggregate(if({df} < 3, cast(array() as array<int>), sequence(1, int({df} div 2))), struct({first} as term, transform(array(sqrt({h})), q_ -> {erfc('q_')})[0] as sum), (s_, n_) -> struct(s_.term * {h} / (n_ + 0.5D) as term, s_.sum + s_.term as sum), s_ -> s_.sum)"
    return f"if({x} is null or {df} is null, null, if({x} <= 0, 1D, least(1D, if({df} % 2 = 0, {even}, {odd}))))"
