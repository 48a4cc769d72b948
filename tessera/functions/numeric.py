"""Small numerical routines for driver-side parameters."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def matrix_exponential(a: np.ndarray) -> np.ndarray:
    """exp(a) by scaling, a Taylor sum and repeated squaring."""
    a = np.asarray(a, float)
    s = max(0, int(np.ceil(np.log2(max(np.abs(a).sum(1).max(), 1e-300)))) + 4)
    x = a / 2.0**s
    out, term = np.eye(len(a)), np.eye(len(a))
    for k in range(1, 20):
        term = term @ x / k
        out = out + term
    for _ in range(s):
        out = out @ out
    return out


def minimise(f: Callable[[float], float], low: float, high: float, tol: float = 1e-9) -> float:
    """Argument of the minimum of a unimodal function, by golden sections."""
    g = (np.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tol * (1 + abs(a) + abs(b)):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def root(f: Callable[[float], float], low: float, high: float, tol: float = 1e-12) -> float:
    """A root between two arguments of opposite sign, by bisection."""
    fl = f(low)
    if fl * f(high) > 0:
        raise ValueError("no sign change")
    while high - low > tol * (1 + abs(low) + abs(high)):
        m = (low + high) / 2
        if fl * f(m) <= 0:
            high = m
        else:
            low, fl = m, f(m)
    return (low + high) / 2
